"""Training-data operators: cleaning, deduplication, formatting, tokenising and scoring of document tables.

Nothing else in the library imports this subpackage.
"""
