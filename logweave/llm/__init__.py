"""Operators for preparing training data: scoring, duplicates, archives, tokens, search, mixing and secrets."""
