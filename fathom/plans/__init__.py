"""Composed plans: settings, retrieval pipelines, ingestion and evaluation."""
