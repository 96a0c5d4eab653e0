"""Queries of traversals, flows and risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import maintain as O
from loomgraph.operators import traverse as T
from loomgraph.plans.registry import Registry

R = Registry()
q = R.add

_CHANGED = "ch AS (SELECT DISTINCT file_path FROM n WHERE kind = 'File' AND updated_at >= (SELECT max(updated_at) FROM n) - INTERVAL 180 DAYS)"
_W = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in rules.IMPACT_WEIGHTS.items()) + " ELSE 0.5 END::double"
_IMPACT = f""", {_CHANGED}, l AS (SELECT CASE WHEN kind = 'TESTED_BY' THEN source_qualified ELSE target_qualified END AS s, CASE WHEN kind = 'TESTED_BY' THEN target_qualified ELSE source_qualified END AS d, max({_W}) AS w FROM e WHERE source_qualified IS NOT NULL AND target_qualified IS NOT NULL AND coalesce(kind, '') <> 'CONTAINS' GROUP BY 1, 2),
sd AS (SELECT qualified_name AS qn FROM n WHERE file_path IN (SELECT file_path FROM ch)),
m AS (SELECT qualified_name AS qn, name, regexp_replace(qualified_name, '\\.[^.]*$', '') AS cls FROM n WHERE kind IN ('Function', 'Test') AND parent_name IS NOT NULL),
br AS (SELECT DISTINCT o.qn FROM m JOIN sd ON sd.qn = m.qn JOIN e i ON i.kind IN ('INHERITS', 'IMPLEMENTS') AND i.source_qualified = m.cls JOIN m o ON o.cls = i.target_qualified AND o.name = m.name WHERE o.qn NOT IN (SELECT qn FROM sd)),
b0 AS (SELECT qn, 1.0::double AS sc, false AS direct, true AS seed FROM sd UNION ALL SELECT qn, 1.0, true, false FROM br),
r1 AS (SELECT d AS qn, max(sc * w * 0.6::double) AS nw FROM b0 JOIN l ON l.s = b0.qn GROUP BY 1 HAVING max(sc * w * 0.6::double) > 0.05),
b1 AS (SELECT coalesce(b0.qn, r1.qn) AS qn, greatest(coalesce(sc, 0), coalesce(nw, 0)) AS sc, coalesce(direct, false) OR coalesce(nw > coalesce(sc, 0), false) AS direct, coalesce(seed, false) AS seed, coalesce(nw > coalesce(sc, 0), false) AS fresh FROM b0 FULL JOIN r1 ON b0.qn = r1.qn),
r2 AS (SELECT d AS qn, max(sc * w * 0.6::double) AS nw FROM b1 JOIN l ON l.s = b1.qn WHERE fresh GROUP BY 1 HAVING max(sc * w * 0.6::double) > 0.05),
b2 AS (SELECT coalesce(b1.qn, r2.qn) AS qn, greatest(coalesce(sc, 0), coalesce(nw, 0)) AS sc, coalesce(direct, false) AS direct, coalesce(seed, false) AS seed FROM b1 FULL JOIN r2 ON b1.qn = r2.qn),
hit AS (SELECT n.qualified_name, n.kind, n.file_path, round(sc, 4) AS score, direct FROM b2 JOIN n ON n.qualified_name = b2.qn WHERE NOT seed) """


@q("f1_impact_radius", _IMPACT + "SELECT * FROM hit", graph=True)
def _(t, n, e):
    return T.impact(n, e, T.recent_files(n))


@q("f6_impact_totals", _IMPACT + "SELECT file_path, count(*) AS items, sum(direct::int) AS direct FROM hit GROUP BY 1", graph=True)
def _(t, n, e):
    return T.impact_totals(T.impact(n, e, T.recent_files(n)))


@q("f5_impact_reasons", _IMPACT + f""", li AS (SELECT source_qualified AS via, target_qualified AS qn, kind FROM e WHERE kind = 'TESTED_BY' UNION ALL SELECT target_qualified, source_qualified, kind FROM e WHERE coalesce(kind, '') NOT IN ('TESTED_BY', 'CONTAINS'))
SELECT qualified_name, kind, via FROM (SELECT li.qn AS qualified_name, coalesce(li.kind, '') AS kind, via, row_number() OVER (PARTITION BY li.qn ORDER BY -({_W.replace('CASE kind', 'CASE li.kind')}), coalesce(li.kind, ''), via) AS k FROM li JOIN sd ON sd.qn = li.via JOIN hit ON hit.qualified_name = li.qn AND hit.direct) WHERE k = 1""", graph=True)
def _(t, n, e):
    files = T.recent_files(n)
    return T.impact_reasons(e, n.join(files, "file_path", "left_semi"), T.impact(n, e, files))


#: Tests of nodes in SQL: ts(qn, test, hops).
TESTS_SQL = """, tb AS (SELECT DISTINCT source_qualified AS qn, target_qualified AS test FROM e WHERE kind = 'TESTED_BY' AND source_qualified IS NOT NULL AND target_qualified IN (SELECT qualified_name FROM n)),
t1 AS (SELECT qn, test, 0 AS hops FROM tb UNION ALL SELECT DISTINCT c.source_qualified, tb.test, 1 FROM e c JOIN tb ON tb.qn = c.target_qualified WHERE c.kind = 'CALLS'),
ow AS (SELECT qualified_name AS o, qualified_name AS m FROM n UNION SELECT n.qualified_name, e.target_qualified FROM e JOIN n ON n.qualified_name = e.source_qualified AND n.kind = 'Class' WHERE e.kind = 'CONTAINS' UNION SELECT f.qualified_name, x.qualified_name FROM n f JOIN n x ON x.file_path = f.file_path AND x.kind IN ('Class', 'Function', 'Method') WHERE f.kind = 'File'),
ts AS (SELECT o AS qn, test, min(hops) AS hops FROM ow JOIN t1 ON t1.qn = ow.m GROUP BY 1, 2) """


@q("f8_transitive_tests", TESTS_SQL + "SELECT qn AS qualified_name, test, hops FROM ts", graph=True)
def _(t, n, e):
    return T.transitive_tests(n, e)


_ENTRY = """, ep AS (SELECT f.id, f.qualified_name, f.name, f.kind, f.file_path FROM n f LEFT JOIN (SELECT file_path, is_test FROM n WHERE kind = 'File') x ON x.file_path = f.file_path WHERE f.kind IN ('Function', 'Test') AND NOT f.is_test AND NOT coalesce(x.is_test, false) AND (f.qualified_name NOT IN (SELECT target_qualified FROM e WHERE kind = 'CALLS' AND target_qualified IS NOT NULL AND coalesce(source_qualified, '') NOT IN (SELECT qualified_name FROM n WHERE kind = 'File')) OR regexp_matches(f.name, '^main$|^test_|^Test[A-Z]|^on_|^handle_|^handler$|^handle$|^upgrade$|^downgrade$|^(middleware|transform|resolve|render)$'))) """


@q("f9_entry_points", _ENTRY + "SELECT id, qualified_name FROM ep", graph=True)
def _(t, n, e):
    return T.entry_points(n, e).select("id", "qualified_name")


_FLOWS = _ENTRY + """, ca AS (SELECT DISTINCT s.id AS src, d.id AS dst FROM e JOIN n s ON s.qualified_name = e.source_qualified JOIN n d ON d.qualified_name = e.target_qualified AND d.kind IN ('Function', 'Test', 'Class') WHERE e.kind = 'CALLS'),
fl(entry, node, depth) AS (SELECT id, id, 0 FROM ep UNION SELECT fl.entry, ca.dst, fl.depth + 1 FROM fl JOIN ca ON ca.src = fl.node WHERE fl.depth < 15), fm AS (SELECT entry, node, min(depth) AS depth FROM fl GROUP BY 1, 2), fx AS (SELECT * FROM fm WHERE entry IN (SELECT entry FROM fm WHERE depth > 0)) """


@q("f10_flow_trace", _FLOWS + "SELECT entry, node, depth FROM fx", graph=True)
def _(t, n, e):
    return T.trace_flows(n, e, T.entry_points(n, e))


_CRITICALITY = _FLOWS + """, fa AS (SELECT n.id AS node, n.file_path, regexp_matches(lower(n.name) || ' ' || lower(n.qualified_name), '""" + "|".join(rules.SECURITY) + """')::int AS sec, coalesce(o.c, 0) AS o, (x.qn IS NOT NULL)::int AS t FROM n LEFT JOIN (SELECT source_qualified AS qn, count(*) AS c FROM e WHERE kind = 'CALLS' AND target_qualified IS NOT NULL AND target_qualified NOT IN (SELECT qualified_name FROM n) GROUP BY 1) o ON o.qn = n.qualified_name LEFT JOIN (SELECT DISTINCT source_qualified AS qn FROM e WHERE kind = 'TESTED_BY') x ON x.qn = n.qualified_name)
SELECT entry, count(*) AS nodes, count(DISTINCT file_path) AS files, max(depth) AS depth, round(least(greatest(0.30::double * least((count(DISTINCT file_path) - 1) / 4.0::double, 1.0::double) + 0.20::double * least(sum(o) / 5.0::double, 1.0::double) + 0.25::double * (sum(sec) / count(*)) + 0.15::double * (1 - sum(t) / count(*)) + 0.10::double * least(max(depth) / 10.0::double, 1.0::double), 0), 1), 4) AS criticality FROM fx JOIN fa USING (node) GROUP BY 1"""


@q("f12_criticality", _CRITICALITY, graph=True)
def _(t, n, e):
    return T.criticality(n, e, T.entry_points(n, e))


@q("f11_flows_ranked", _CRITICALITY.replace("\nSELECT entry", ", cx AS (SELECT entry") + ") SELECT *, row_number() OVER (ORDER BY criticality DESC, entry) AS place FROM cx QUALIFY place <= 50", graph=True)
def _(t, n, e):
    """The most critical flows (a top-k report)."""
    top = T.criticality(n, e, T.entry_points(n, e)).orderBy(F.desc("criticality"), "entry").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("criticality"), "entry")))  # fifty rows


@q("o8_merge_flows", _FLOWS + """, nw AS (SELECT entry, list_sort(list(node)) AS p FROM fx GROUP BY 1), od AS (SELECT entry_point_id AS entry, list_sort(list_distinct(from_json(path_json, '["BIGINT"]'))) AS p FROM flows WHERE entry_point_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entry_point_id ORDER BY updated_at DESC, id DESC) = 1)
SELECT coalesce(od.entry, nw.entry) AS entry, CASE WHEN od.entry IS NULL THEN 'insert' WHEN nw.entry IS NULL THEN 'delete' WHEN od.p = nw.p THEN 'keep' ELSE 'update' END AS action FROM od FULL JOIN nw ON od.entry = nw.entry""", graph=True)
def _(t, n, e):
    """Stored flows against those of the graph as it is."""
    f = t("flows").where("entry_point_id is not null").groupBy(F.col("entry_point_id").alias("entry")).agg(F.max_by("path_json", F.struct("updated_at", "id")).alias("path_json"))
    old = f.select("entry", F.explode_outer(F.array_distinct(F.from_json("path_json", "array<bigint>"))).alias("node"))
    return O.merge_flows(O.path_marks(old), O.path_marks(T.trace_flows(n, e, T.entry_points(n, e)).select("entry", "node")))


@q("f14_dependents", """, li AS (SELECT DISTINCT string_split(target_qualified, '::')[1] AS file, file_path AS dependent FROM e WHERE coalesce(kind, '') <> 'CONTAINS' AND string_split(target_qualified, '::')[1] <> file_path AND string_split(target_qualified, '::')[1] IN (SELECT file_path FROM n WHERE kind = 'File'))
SELECT file, dependent, min(hops) AS hops FROM (SELECT file, dependent, 1 AS hops FROM li UNION ALL SELECT DISTINCT a.file, b.dependent, 2 FROM li a JOIN li b ON b.file = a.dependent WHERE a.file <> b.dependent) GROUP BY 1, 2""", graph=True)
def _(t, n, e):
    return T.dependents(n, e)


@q("f15_affected_flows", f""", {_CHANGED}
SELECT f.id AS flow_id, f.name, f.criticality, count(DISTINCT m.node_id) AS hits FROM flow_memberships m JOIN flows f ON f.id = m.flow_id WHERE m.node_id IN (SELECT id FROM n WHERE file_path IN (SELECT file_path FROM ch)) GROUP BY 1, 2, 3""", graph=True)
def _(t, n, e):
    return T.affected_flows(t("flow_memberships"), t("flows"), n, T.recent_files(n))


@q("f16_flow_steps", ", s AS (SELECT id AS flow_id, unnest(from_json(path_json, '[\"BIGINT\"]')) AS node_id, generate_subscripts(from_json(path_json, '[\"BIGINT\"]'), 1) - 1 AS position FROM flows) SELECT flow_id, position, node_id, n.qualified_name FROM s LEFT JOIN n ON n.id = s.node_id", graph=True)
def _(t, n, e):
    return T.flow_steps(t("flows"), n)


@q("f17_neighbour_files", ", p AS (SELECT string_split(source_qualified, '::')[1] AS a, string_split(target_qualified, '::')[1] AS b FROM e WHERE kind IN ('CALLS', 'IMPORTS_FROM') AND source_qualified IS NOT NULL AND target_qualified LIKE '/%') SELECT a AS file, b AS neighbour FROM p WHERE a <> b UNION SELECT b, a FROM p WHERE a <> b", graph=True)
def _(t, n, e):
    return T.neighbour_files(e)


@q("f18_referrer_files", ", g AS (SELECT DISTINCT replace(qualified_name, '\\', '/') AS qn FROM node_tombstones WHERE qualified_name IS NOT NULL) SELECT DISTINCT file_path FROM e WHERE (source_qualified IN (SELECT qn FROM g) OR target_qualified IN (SELECT qn FROM g)) AND file_path NOT IN (SELECT string_split(qn, '::')[1] FROM g)", graph=True)
def _(t, n, e):
    return T.referrer_files(e, t("node_tombstones").select(F.translate("qualified_name", "\\", "/").alias("qualified_name")))


@q("g5_flow_snapshots", "SELECT id AS flow_id, p[1] AS entry, CASE WHEN len(p) > 2 THEN p[2:least(4, len(p) - 1)] ELSE [] END AS middle, p[len(p)] AS last FROM (SELECT id, from_json(path_json, '[\"BIGINT\"]') AS p FROM flows) WHERE len(p) > 0")
def _(t):
    return T.flow_snapshots(t("flows"))


@q("m1_flows_ranked", "SELECT id, name, criticality FROM flows ORDER BY criticality DESC NULLS LAST, depth DESC, node_count DESC, id LIMIT 50")
def _(t):
    return t("flows").orderBy(F.desc_nulls_last("criticality"), F.desc("depth"), F.desc("node_count"), "id").limit(50).select("id", "name", "criticality")


@q("m2_flows_by_entry_kind", "SELECT n.kind, count(*) AS flows, round(max(criticality), 6) AS top FROM flows f JOIN n ON n.id = f.entry_point_id GROUP BY 1", graph=True)
def _(t, n, e):
    return t("flows").join(n.select(F.col("id").alias("entry_point_id"), "kind"), "entry_point_id").groupBy("kind").agg(F.count(F.lit(1)).alias("flows"), F.round(F.max("criticality"), 6).alias("top"))


@q("m3_flows_by_name", "SELECT asked, id AS flow_id, name FROM (SELECT asked, f.id, f.name, row_number() OVER (PARTITION BY asked ORDER BY f.id) AS k FROM flows f JOIN (VALUES ('load'), ('Rank'), ('zzz')) a(asked) ON contains(lower(f.name), lower(asked))) WHERE k = 1")
def _(t):
    f = t("flows")
    return T.flows_by_name(f, f.sparkSession.createDataFrame([("load",), ("Rank",), ("zzz",)], "asked string"))
