"""quireflow.functions"""
