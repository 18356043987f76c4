"""Operators of a training-data pipeline: quality, duplicates, contamination, privacy, encoding, sharding and scoring."""
