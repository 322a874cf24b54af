"""Training-data operators: scoring, tokens, filters, near-duplicates, packing.

Nothing else in the library imports this subpackage.
"""
