"""Operators of a training-data pipeline: near-duplicates, search, dedup, quality, mixing, packing, chat."""
