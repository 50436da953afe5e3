"""Operators that prepare text and embedding corpora for model training."""
