"""Operators for preparing text corpora, their queries and SQL twins."""
