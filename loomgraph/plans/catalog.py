"""All queries of the core and their SQL."""

from __future__ import annotations

from loomgraph.plans import dealt, graph_queries, memory_queries, search_queries, structure_queries, traverse_queries

QUERIES = {**dealt.QUERIES}
ORACLE = {**dealt.ORACLE}
for _m in (graph_queries, traverse_queries, structure_queries, search_queries, memory_queries):
    QUERIES |= _m.R.queries
    ORACLE |= _m.R.sql
