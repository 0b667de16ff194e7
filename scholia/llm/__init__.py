"""Operators of a training-data pipeline: dedup, filtering, tokenising, packing."""
