"""Training-data operators: tokenisation, packing, quality, safety and near-duplicates.

Nothing else in the library imports this subpackage.
"""
