"""Operators for training data: tokens, duplicates, contamination, toxicity, personal data, shards."""
