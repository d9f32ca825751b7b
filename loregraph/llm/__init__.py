"""Operators for training-data pipelines over code-knowledge tables. Nothing else in the library imports this."""
