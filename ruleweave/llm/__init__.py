"""Operators for large text corpora: cleaning, duplicates, tokens, packing, search."""
