"""Queries p2 and p5 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.operators import hotkeys, orphans
from loomgraph.sources.tables import table


def _state(spark: SparkSession, d: str) -> orphans.OrphanState:
    t = lambda n: table(spark, d, n)
    return orphans.advance(None, *map(t, ("edges", "nodes", "node_tombstones", "external_symbols", "flow_memberships", "flows")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(_state(spark, d))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(_state(spark, d))


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return orphans.waiting_snapshots(_state(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_keys(table(spark, d, "edges"), ["kind", "target_qualified"], "id", 0.01).select("kind", "target_qualified")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.key_profile(table(spark, d, "edges"))


QUERIES = {"p2_found": p2_found, "p2_counts": p2_counts, "p2_snapshots": p2_snapshots, "p5_found": p5_found, "p5_profile": p5_profile}

_NORM = "CASE WHEN instr({0}, '::') > 0 THEN replace(substr({0}, 1, instr({0}, '::') - 1), '\\', '/') || substr({0}, instr({0}, '::')) ELSE replace({0}, '\\', '/') END"
_P2 = f"""WITH n AS (SELECT id, {_NORM.format('qualified_name')} AS k, min(ingested_at) AS a, max(ingested_at) AS z FROM nodes GROUP BY 1, 2),
ti AS (SELECT node_id AS id, max(deleted_at) AS d FROM node_tombstones WHERE node_id IS NOT NULL GROUP BY 1),
tn AS (SELECT {_NORM.format('qualified_name')} AS k, max(deleted_at) AS d FROM node_tombstones WHERE qualified_name IS NOT NULL GROUP BY 1),
p AS (SELECT n.*, greatest(coalesce(ti.d, timestamp '1900-01-01'), coalesce(tn.d, timestamp '1900-01-01')) >= z AS gone FROM n LEFT JOIN ti USING (id) LEFT JOIN tn USING (k)),
x AS (SELECT DISTINCT {_NORM.format('qualified_name')} AS k FROM external_symbols),
e AS (SELECT id, min(ingested_at) AS made, min(updated_at) AS u, min({_NORM.format('source_qualified')}) AS s, min({_NORM.format('target_qualified')}) AS t FROM edges GROUP BY id),
r AS (SELECT 'source_qualified' AS ref_field, id, made, u, s AS k FROM e WHERE s IS NOT NULL UNION ALL SELECT 'target_qualified', id, made, u, t FROM e WHERE t IS NOT NULL),
m AS (SELECT DISTINCT flow_id, node_id FROM flow_memberships WHERE node_id IS NOT NULL),
f AS (SELECT id, min(created_at) AS c FROM flows GROUP BY id),
found AS (SELECT 'edges' AS ref_table, ref_field, strftime(u, '%Y-%m') AS period, cast(r.id AS varchar) AS row_key FROM r LEFT JOIN p ON p.k = r.k LEFT JOIN x ON x.k = r.k WHERE (p.k IS NULL AND x.k IS NULL) OR p.gone OR p.a > r.made
UNION ALL SELECT 'flow_memberships', 'node_id', strftime(f.c, '%Y-%m'), concat(m.flow_id, ':', m.node_id) FROM m LEFT JOIN f ON f.id = m.flow_id LEFT JOIN p ON p.id = m.node_id WHERE p.id IS NULL OR p.gone OR p.a > f.c) """

_NN = _NORM.format("qualified_name")
_SNAPSHOTS = f"""WITH nn AS (SELECT DISTINCT id, {_NN} AS k FROM nodes),
mv AS (SELECT 'n' || {_NN} AS key, ingested_at AS ts, false AS gone FROM nodes UNION ALL SELECT 'i' || id, ingested_at, false FROM nodes
UNION ALL SELECT 'n' || nn.k, t.deleted_at, true FROM node_tombstones t JOIN nn ON nn.id = t.node_id UNION ALL SELECT 'n' || nn.k, t.deleted_at, true FROM (SELECT {_NN} AS k, deleted_at FROM node_tombstones) t JOIN nn USING (k)
UNION ALL SELECT 'i' || nn.id, t.deleted_at, true FROM node_tombstones t JOIN nn ON nn.id = t.node_id UNION ALL SELECT 'i' || nn.id, t.deleted_at, true FROM (SELECT {_NN} AS k, deleted_at FROM node_tombstones) t JOIN nn USING (k)),
mm AS (SELECT key, ts, bool_or(gone) AS gone FROM mv WHERE key IS NOT NULL GROUP BY 1, 2),
fl AS (SELECT * FROM (SELECT *, lag(gone) OVER (PARTITION BY key ORDER BY ts) AS was FROM mm) WHERE was IS NULL OR was <> gone),
ga AS (SELECT key, CASE WHEN was IS NOT NULL THEN ts END AS since, CASE WHEN was IS NULL AND NOT gone THEN ts ELSE coalesce(nx, timestamp 'infinity') END AS til FROM (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts) AS nx FROM fl) WHERE was IS NULL OR gone),
e AS (SELECT id, min(ingested_at) AS made, min({_NORM.format('source_qualified')}) AS s, min({_NORM.format('target_qualified')}) AS t FROM edges WHERE id IS NOT NULL GROUP BY id),
r AS (SELECT 'source_qualified' AS ref_field, made, 'n' || s AS key FROM e WHERE s IS NOT NULL UNION ALL SELECT 'target_qualified', made, 'n' || t FROM e WHERE t IS NOT NULL
UNION ALL SELECT 'node_id', c, 'i' || node_id FROM (SELECT DISTINCT flow_id, node_id FROM flow_memberships WHERE node_id IS NOT NULL) m JOIN (SELECT id, min(created_at) AS c FROM flows GROUP BY id) f ON f.id = m.flow_id),
x AS (SELECT DISTINCT 'n' || {_NN} AS key FROM external_symbols),
hit AS (SELECT ref_field, made, since, til FROM r JOIN ga USING (key) WHERE til > made UNION ALL SELECT ref_field, made, NULL, timestamp 'infinity' FROM r WHERE key NOT IN (SELECT key FROM mm) AND key NOT IN (SELECT key FROM x)),
ev AS (SELECT ref_field, strftime(greatest(made, coalesce(since, made)), '%Y-%m') AS period, 1 AS o, (coalesce(since > made, false))::int AS p, 0 AS q FROM hit UNION ALL SELECT ref_field, strftime(til, '%Y-%m'), 0, 0, 1 FROM hit WHERE til < timestamp 'infinity'),
g AS (SELECT ref_field, period, sum(o)::bigint AS opened, sum(p)::bigint AS reopened, sum(q)::bigint AS resolved FROM ev GROUP BY 1, 2)
SELECT ref_field, period, opened, reopened, resolved, (sum(opened - resolved) OVER (PARTITION BY ref_field ORDER BY period))::bigint AS waiting FROM g"""

ORACLE = {
    "p2_found": _P2 + "SELECT ref_table, ref_field, period, row_key FROM found",
    "p2_counts": _P2 + "SELECT ref_table, ref_field, period, count(*) AS orphans FROM found GROUP BY 1, 2, 3",
    "p2_snapshots": _SNAPSHOTS,
    "p5_found": "SELECT kind, target_qualified FROM edges WHERE kind IS NOT NULL AND target_qualified IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT id) * 100 >= (SELECT count(DISTINCT id) FROM edges)",
    "p5_profile": """WITH e AS (SELECT id, min(kind) AS kind, min(target_qualified) AS target_qualified, min(source_qualified) AS s, min(file_path) AS f, min(line) AS line FROM edges WHERE kind IS NOT NULL AND target_qualified IS NOT NULL GROUP BY id)
SELECT kind, target_qualified, count(*) AS edges, count(DISTINCT s) AS callers, count(DISTINCT f) AS files, cast(quantile_disc(line, 0.5) AS double) AS line_p50, cast(quantile_disc(line, 0.9) AS double) AS line_p90 FROM e GROUP BY 1, 2""",
}
