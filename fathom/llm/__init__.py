"""Operators for training-data pipelines: filters, dedup, tokenizing, media and archives."""
