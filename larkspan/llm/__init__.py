"""Operators for large text, page and vector corpora. Nothing else in the library imports this package."""
