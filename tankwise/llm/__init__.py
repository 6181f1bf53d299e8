"""Training-data operators: quality rules, near-duplicate detection, PII, sharding, mixing, tokenising.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
