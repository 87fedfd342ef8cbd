"""Operators for preparing training text: sharding, extraction, filtering, matching, packing."""
