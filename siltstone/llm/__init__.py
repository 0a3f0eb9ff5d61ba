"""Operators for preparing large text collections: filters, search, mixing, packing, near-duplicates and more."""
