"""Operators for training-data preparation: scoring, filtering, deduplication, packing and archiving of texts.

Nothing else in the package imports this folder.
"""
