"""Operators for training-data corpora, and their queries on the given tables."""
