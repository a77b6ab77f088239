"""Operators over text corpora for training-data pipelines."""
