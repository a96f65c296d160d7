"""Operators for preparing training data: dedup, quality, scoring, tokens, packing, extraction.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``registry`` holds the thin queries over the
given tables and their SQL.
"""
