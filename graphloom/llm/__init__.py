"""Operators for preparing training data: dedup, mixing, sharding, filters, packing."""
