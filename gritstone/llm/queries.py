"""All queries of the training-data operators, with SQL where DuckDB can express them."""

from __future__ import annotations

from . import bpe, conversation, exact_dedup, html_text, lexical, line_dedup, mixing, packing, quality, simhash, suffix_dedup, url_filter, vector_dedup

MODULES = (url_filter, quality, exact_dedup, suffix_dedup, line_dedup, packing, simhash, vector_dedup, html_text, bpe, lexical, conversation, mixing)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
