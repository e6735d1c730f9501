"""Operators for preparing training data: deduplication, labelling, scoring, packing and formatting."""
