"""Relational operators over heap, catalog and report tables."""
