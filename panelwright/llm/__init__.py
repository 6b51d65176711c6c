"""Operators over text corpora for training-data pipelines; see README.md for the list."""
