"""Operators for training-data corpora: duplicates, quality, contamination, tokens, toxicity, scoring, licences."""
