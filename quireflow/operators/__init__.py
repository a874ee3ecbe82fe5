"""quireflow.operators"""
