"""Training-data operators (deduplication, scoring, packing, mixing, media).

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
