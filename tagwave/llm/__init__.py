"""Operators for preparing training data: extraction, deduplication, scans, scoring, packing.

Nothing else in the library imports this subpackage. Each module holds one operator with a
general interface; ``queries`` registers the thin queries over the given tables.
"""
