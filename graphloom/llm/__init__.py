"""Training-data operators: deduplication, archives, scoring, filtering and mixing.

Nothing else in the package imports this subpackage.
"""
