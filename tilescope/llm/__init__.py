"""Operators for preparing training data: near duplicates, counts, filters, scoring, mixing and search."""
