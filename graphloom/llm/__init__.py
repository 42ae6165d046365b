"""Operators for large training-data corpora (deduplication, filtering, encoding, sharding).

Nothing else in ``graphloom`` imports this subpackage.
"""
