"""Operators of a training-data pipeline (deduplication, mixing, filtering,
counting, packing). Nothing else in the library imports this package."""
