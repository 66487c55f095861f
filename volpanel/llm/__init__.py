"""Operators for preparing training data: filters, deduplication, search, archives, packing and mixing."""
