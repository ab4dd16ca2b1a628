"""Operators for preparing training data from code and text corpora."""
