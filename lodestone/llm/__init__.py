"""Operators of a training-data pipeline: scoring, filtering, deduplication, mixing, encoding."""
