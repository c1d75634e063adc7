"""Training-data operators: deduplication, filtering, secrets, formatting, mixing, tokenizing.

Nothing else in the library imports this subpackage.
"""
