"""Operators for training-data pipelines: deduplication, filters, models, packing.

Nothing else in the library imports this package.
"""
