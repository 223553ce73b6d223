"""Training-data operators: near-duplicate search, packing, mixing, filters and classifiers.

Nothing else in the library imports this subpackage; `queries.py` holds its driver queries.
"""
