"""Operators for training-data pipelines: documents in, documents or findings out."""
