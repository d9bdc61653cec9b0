"""Operators for training-data corpora: extraction, dedup, filtering, mixing, packing."""
