"""Operators for preparing training text: deduplication, tokens, scoring, search, mixing."""
