"""Corpus operators for training data: packing, deduplication, quality, privacy, search and tokens."""
