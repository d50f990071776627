"""Training-data operators: filtering, deduplication, tokenising, search, mixing and sharding of corpora.

Nothing outside this subpackage imports it.
"""
