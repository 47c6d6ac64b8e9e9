"""Training-data operators: mixing, extraction, scoring, search, deduplication and tokenizing.

Nothing else in the library imports this subpackage.
"""
