"""Operators for preparing training text: filters, deduplication, scoring and mixing of documents."""
