"""Operators for preparing language-model training data.

Nothing outside this folder, ``corpus_pipeline.py`` and the entry module
imports it.
"""
