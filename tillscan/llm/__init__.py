"""Training-data operators: sharding, filtering, deduplication, mixing, tokenising.

Nothing outside this subpackage imports it. Each module holds one operator with its
general interface and the thin ``opN_<name>`` query over the driver tables.
"""
