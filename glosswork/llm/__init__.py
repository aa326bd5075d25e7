"""Training-data operators: packing, dedup, formatting, mixing, search, encoding and filters.

Nothing outside this subpackage imports it.
"""
