"""All queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from rxloom.plans import data_queries, load_queries, reference_queries

MODULES = [reference_queries, load_queries, data_queries]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
FLAGSHIP = "daily_trend"
