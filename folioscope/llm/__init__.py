"""Training-data operators: crawl archives, extraction, scoring, dedup, mixing, tokens, shards.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own interface; ``queries`` holds the thin ``opN_<name>`` queries.
"""
