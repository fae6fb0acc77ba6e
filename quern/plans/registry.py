"""Every query of the library proper, by name, with the SQL that checks it."""

from __future__ import annotations

from quern.plans import corpus_queries, evaluation_queries, more_queries, structure_queries, text_queries

MODULES = (text_queries, corpus_queries, evaluation_queries, more_queries, structure_queries)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
