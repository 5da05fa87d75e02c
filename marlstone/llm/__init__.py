"""Training-data operators (token output, sharding, dedup, packing, ...).

Nothing outside this subpackage imports it.
"""
