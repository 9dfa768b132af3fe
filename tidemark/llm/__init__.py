"""Training-data operators: quality, duplicates, tokens, chat, shards and mixes.

Nothing outside this subpackage imports it.  Each operator module has a general
DataFrame interface; :mod:`tidemark.llm.catalog` has the thin registered queries.
"""
