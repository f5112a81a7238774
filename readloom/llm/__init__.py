"""Training-data operators: dedup, sharding, tokenizing, classifiers, extraction.

Nothing outside this subpackage imports it; it imports nothing from the rest.
"""
