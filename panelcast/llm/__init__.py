"""Operators of a training-data pipeline: near-duplicates, token counts, toxicity, quality, encoding, sharding, mixing."""
