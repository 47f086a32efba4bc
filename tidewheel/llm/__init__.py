"""Operators for training-data pipelines: scoring, deduplication, tokens, mixing, sharding."""
