"""Operators of a training-data pipeline: dedup, filtering, extraction, tokens."""
