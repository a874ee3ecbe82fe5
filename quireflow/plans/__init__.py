"""quireflow.plans"""
