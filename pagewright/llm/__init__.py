"""Operators for text corpora: wrong encodings, token ids, packing and truncation. Nothing outside imports this package."""
