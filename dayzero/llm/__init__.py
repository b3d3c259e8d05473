"""Operators for training-data pipelines: extraction, filters, near-duplicates, mixing, tokens.

Nothing else in the library imports this package.
"""
