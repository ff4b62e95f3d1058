"""Training-data operators: dedup, search, packing, scans, tokenisation, scoring, sharding, toxicity.

Nothing outside this subpackage imports it; `queries` registers its operators with the entry module.
"""
