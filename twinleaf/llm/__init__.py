"""Training-data operators (sharding, packing, scoring, deduplication, scans).

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
