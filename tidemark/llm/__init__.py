"""Training-data operators: deduplication, classification, mixing, archives and token output.

Nothing outside this subpackage imports it.
"""
