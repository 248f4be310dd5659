"""Operators for building training data: search, filtering, deduplication, archives, mixing.

Nothing outside this folder imports it.
"""
