"""Operators for preparing training data from large text corpora."""
