"""Training-data operators: scoring, deduplication, tokenising and formatting of text corpora.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
