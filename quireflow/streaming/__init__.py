"""quireflow.streaming"""
