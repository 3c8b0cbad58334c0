"""Operators for training-data pipelines. Nothing else in seqloom imports this."""
