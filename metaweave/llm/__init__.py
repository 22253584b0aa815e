"""Operators for training data: deduplication, fingerprints, packing, tokenising, language and URL filters."""
