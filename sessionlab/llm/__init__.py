"""Operators for preparing training data: filtering, deduplication, mixing, encoding, search and scoring."""
