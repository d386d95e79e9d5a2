"""Operators for preparing training data: search, filtering, de-duplication, mixing, packing, archives."""
