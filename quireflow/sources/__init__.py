"""quireflow.sources"""
