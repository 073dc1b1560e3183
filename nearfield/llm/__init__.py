"""Operators of a training-data pipeline: deduplication, filtering, extraction, mixing, packing, archives.

Nothing else in the library imports this subpackage.
"""
