"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.functions import rules
from loomgraph.operators.graph import latest_nodes, unique_edges
from loomgraph.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, with SQL where SQL can express them."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, graph: bool = False) -> Callable[[Callable], Callable]:
        """Register f(t) or, with graph, f(t, n, e): t reads a table by name, n and e are the canonical nodes and edges."""

        def wrap(f: Callable) -> Callable:
            def run(spark: SparkSession, d: str) -> DataFrame:
                def t(x: str) -> DataFrame:
                    return table(spark, d, x)

                return f(t, latest_nodes(t("nodes")), unique_edges(t("edges"))) if graph else f(t)

            self.queries[name] = run
            if sql is not None:
                self.sql[name] = (GRAPH_SQL + sql) if graph else sql
            return f

        return wrap


#: Whether a path below its checkout is ignored, in SQL.
IGNORED_SQL = "regexp_matches(regexp_replace(file_path, '^/(?:[^/]+/[^/]+/[^/]+/)?', ''), '" + "|".join(rules.glob_regex(g) for g in rules.IGNORED_GLOBS + rules.DECLARATION_GLOBS) + "')"
_POSIX = "CASE WHEN instr({0}, '::') > 0 THEN replace(substr({0}, 1, instr({0}, '::') - 1), '\\', '/') || substr({0}, instr({0}, '::')) ELSE replace({0}, '\\', '/') END"
#: The canonical graph in SQL: n and e.
GRAPH_SQL = f"""WITH RECURSIVE n AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY ingested_at DESC, updated_at DESC, id DESC) AS rn FROM nodes) WHERE rn = 1),
e AS MATERIALIZED (SELECT DISTINCT id, kind, {_POSIX.format('source_qualified')} AS source_qualified, {_POSIX.format('target_qualified')} AS target_qualified, file_path, line, extra, confidence, confidence_tier, updated_at FROM edges) """
