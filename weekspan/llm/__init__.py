"""Operators for large text corpora used as training data, their queries and their SQL."""
