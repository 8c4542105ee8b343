"""Operators for preparing training data: search, deduplication, quality, extraction, packing."""
