"""Every query by name, with the SQL that it is compared with."""

from __future__ import annotations

from . import output_queries, paragraph_queries, sentence_queries, table_queries, vector_queries

_MODULES = (paragraph_queries, sentence_queries, vector_queries, output_queries, table_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
