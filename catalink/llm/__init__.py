"""Operators for large text corpora: mixing, cleaning, de-duplication, scoring, tokens and search."""
