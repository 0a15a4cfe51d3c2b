"""Corpus operators for training-data pipelines: tokens, packing, dedup, secrets, search."""
