"""Training-data operators: quality, deduplication, scoring, extraction, mixing, packing and media.

Nothing else in the library imports this subpackage.
"""
