"""Queries over the canonical graph: scans, lookups, joins, named questions, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.names import below_checkout
from loomgraph.operators import graph as G
from loomgraph.operators import patterns as P
from loomgraph.plans.registry import _POSIX, IGNORED_SQL, Registry

R = Registry()
q = R.add
_PAIR = "SELECT DISTINCT target_qualified AS target, source_qualified AS answer FROM e WHERE kind IN ({}) AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL AND source_qualified IN (SELECT qualified_name FROM n)"
_OUT = "SELECT DISTINCT source_qualified AS target, target_qualified AS answer FROM e WHERE kind IN ({}) AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL AND target_qualified IN (SELECT qualified_name FROM n{})"
_LOST = "(kind, extra) "


@q("a1_all_nodes", "SELECT id, qualified_name, kind, name FROM n WHERE kind <> 'File'", graph=True)
def _(t, n, e):
    return n.where("kind <> 'File'").select("id", "qualified_name", "kind", "name")


@q("a2_all_edges", "SELECT id, kind, source_qualified, target_qualified, line FROM e", graph=True)
def _(t, n, e):
    return e.select("id", "kind", "source_qualified", "target_qualified", "line")


@q("a3_all_files", "SELECT file_path FROM n WHERE file_path IS NOT NULL UNION SELECT file_path FROM e WHERE file_path IS NOT NULL", graph=True)
def _(t, n, e):
    return G.all_files(n, e)


@q("a4_file_markers", "SELECT DISTINCT file_path FROM n WHERE kind = 'File'", graph=True)
def _(t, n, e):
    return n.where("kind = 'File'").select("file_path").distinct()


@q("a5_file_test_flags", "SELECT file_path, is_test FROM n WHERE kind = 'File'", graph=True)
def _(t, n, e):
    return G.file_test_flags(n)


@q("b1_nodes_by_name", f", a AS (SELECT DISTINCT qualified_name AS asked, {_POSIX.format('qualified_name')} AS posix FROM node_tombstones WHERE qualified_name IS NOT NULL) SELECT asked, coalesce(x.id, y.id) AS id, coalesce(x.kind, y.kind) AS kind FROM a LEFT JOIN n x ON x.qualified_name = asked LEFT JOIN n y ON y.qualified_name = posix WHERE x.id IS NOT NULL OR y.id IS NOT NULL", graph=True)
def _(t, n, e):
    return G.nodes_by_name(n, t("node_tombstones").select(F.col("qualified_name").alias("asked"))).select("asked", "id", "kind")


@q("b2_nodes_of_files", "SELECT id, qualified_name FROM n WHERE file_path IN (SELECT file_path FROM source_files)", graph=True)
def _(t, n, e):
    return G.semi(n, t("source_files"), "file_path").select("id", "qualified_name")


@q("b3_nodes_by_id", "SELECT id, qualified_name, kind FROM n WHERE id IN (SELECT node_id FROM flow_memberships WHERE node_id IS NOT NULL)", graph=True)
def _(t, n, e):
    return G.semi(n, t("flow_memberships").select(F.col("node_id").alias("id")), "id").select("id", "qualified_name", "kind")


@q("b7_edges_out", "SELECT id, source_qualified, target_qualified FROM e WHERE source_qualified IN (SELECT qualified_name FROM n WHERE id IN (SELECT entry_point_id FROM flows))", graph=True)
def _(t, n, e):
    return G.edges_at(e, G.semi(n, t("flows").select(F.col("entry_point_id").alias("id")), "id"), "source_qualified").select("id", "source_qualified", "target_qualified")


@q("b8_edges_in", "SELECT id, source_qualified, target_qualified FROM e WHERE target_qualified IN (SELECT qualified_name FROM n WHERE id IN (SELECT entry_point_id FROM flows))", graph=True)
def _(t, n, e):
    return G.edges_at(e, G.semi(n, t("flows").select(F.col("entry_point_id").alias("id")), "id"), "target_qualified").select("id", "source_qualified", "target_qualified")


@q("b19_node_ids_of_files", "SELECT file_path, list_sort(list(id)) AS ids FROM n WHERE file_path IN (SELECT file_path FROM source_files) GROUP BY 1", graph=True)
def _(t, n, e):
    return G.semi(n, t("source_files"), "file_path").groupBy("file_path").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # the symbols of one file


@q("b5_nodes_by_kind", "SELECT qualified_name, kind FROM n WHERE kind IN ('Function', 'Class') AND contains(file_path, '/src/')", graph=True)
def _(t, n, e):
    return G.nodes_by_kind(n, ["Function", "Class"], "/src/").select("qualified_name", "kind")


@q("b6_nodes_by_size", "SELECT qualified_name, line_end - line_start + 1 AS lines FROM n WHERE line_end - line_start + 1 >= 20 ORDER BY lines DESC, qualified_name LIMIT 50", graph=True)
def _(t, n, e):
    return G.nodes_by_size(n, 20).select("qualified_name", "lines")


@q("b10_bare_target_edges", "SELECT e.id, e.target_qualified AS name, CASE WHEN n.language IN ('javascript', 'typescript', 'tsx') THEN 'javascript' ELSE n.language END AS family FROM e JOIN n ON n.qualified_name = e.source_qualified WHERE e.kind = 'CALLS' AND NOT contains(e.target_qualified, '::') AND NOT contains(e.target_qualified, '/')", graph=True)
def _(t, n, e):
    return G.bare_target_edges(e, n).select("id", F.col("target_qualified").alias("name"), "family")


@q("b14_without_signature", "SELECT qualified_name FROM n WHERE params IS NULL", graph=True)
def _(t, n, e):
    return n.where("params is null").select("qualified_name")


@q("b15_batch_nodes", "SELECT qualified_name, kind FROM n WHERE qualified_name IN (SELECT target_qualified FROM e WHERE kind = 'INHERITS')", graph=True)
def _(t, n, e):
    return G.semi(n, e.where("kind = 'INHERITS'").select(F.col("target_qualified").alias("qualified_name")), "qualified_name").select("qualified_name", "kind")


@q("b20_flows_of_nodes", "SELECT DISTINCT flow_id FROM flow_memberships WHERE node_id IN (SELECT id FROM n WHERE kind = 'Class')", graph=True)
def _(t, n, e):
    return t("flow_memberships").join(n.where("kind = 'Class'").select(F.col("id").alias("node_id")), "node_id", "left_semi").select("flow_id").distinct()


@q("b21_flow_members", "SELECT DISTINCT m.flow_id, n.qualified_name FROM flow_memberships m JOIN n ON n.id = m.node_id", graph=True)
def _(t, n, e):
    return t("flow_memberships").join(n.select(F.col("id").alias("node_id"), "qualified_name"), "node_id").select("flow_id", "qualified_name").distinct()


@q("b22_neighbours", "SELECT source_qualified AS qualified_name, target_qualified AS other, 'out' AS side FROM e WHERE source_qualified IN (SELECT qualified_name FROM n WHERE kind = 'Class') UNION ALL SELECT target_qualified, source_qualified, 'in' FROM e WHERE target_qualified IN (SELECT qualified_name FROM n WHERE kind = 'Class')", graph=True)
def _(t, n, e):
    c = n.where("kind = 'Class'").select("qualified_name")
    out = e.withColumnRenamed("source_qualified", "qualified_name").join(c, "qualified_name", "left_semi").select("qualified_name", F.col("target_qualified").alias("other"), F.lit("out").alias("side"))
    into = e.withColumnRenamed("target_qualified", "qualified_name").join(c, "qualified_name", "left_semi").select("qualified_name", F.col("source_qualified").alias("other"), F.lit("in").alias("side"))
    return out.unionByName(into)


@q("b24_languages_present", "SELECT language, count(*) > 0 AS present FROM n WHERE language IS NOT NULL GROUP BY language", graph=True)
def _(t, n, e):
    return n.where("language is not null").select("language").distinct().withColumn("present", F.lit(True))


@q("b26_ignored_files", f"SELECT DISTINCT file_path FROM n WHERE kind = 'File' AND {IGNORED_SQL}", graph=True)
def _(t, n, e):
    return n.where("kind = 'File'").where(rules.ignored(below_checkout(F.col("file_path")))).select("file_path").distinct()


@q("b27_framework_decorators", "SELECT qualified_name FROM n WHERE regexp_matches(extra, '\"decorators\": \\[.*(receiver|api_view|[Tt]ask|[Cc]omponent|[Mm]odule|[Qq]uery|[Ii]nject|\\w\\.route|\\w\\.command)') AND json_valid(extra)", graph=True)
def _(t, n, e):
    return n.where(rules.framework_decorator(F.col("extra"))).select("qualified_name")


@q("b28_entry_names", "SELECT qualified_name FROM n WHERE regexp_matches(name, '^main$|^__main__$|^test_|^Test[A-Z]|^on_|^handle_|^handler$|^handle$|^lambda_handler$|^upgrade$|^downgrade$|^lifespan$|^get_db$|^do(Get|Post|Put|Delete)$|^(middleware|errorHandler)$|^(transform|resolve|render)$')", graph=True)
def _(t, n, e):
    return n.where(rules.entry_name(F.col("name"), F.col("language"))).select("qualified_name")


@q("b32_node_projection", "SELECT substr(regexp_replace(qualified_name, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'), 1, 256) AS qualified_name, kind, line_start FROM n", graph=True)
def _(t, n, e):
    return n.select(rules.clean(F.col("qualified_name")).alias("qualified_name"), "kind", "line_start")


@q("c1_edges_with_source", "SELECT e.id, n.kind AS source_kind, n.name AS source_name FROM e JOIN n ON n.qualified_name = e.source_qualified WHERE e.kind = 'CALLS'", graph=True)
def _(t, n, e):
    return G.edges_with_source(e, n).select("id", "source_kind", "source_name")


@q("c2_call_targets", "SELECT DISTINCT target_qualified AS qualified_name FROM e LEFT JOIN n ON n.qualified_name = e.source_qualified WHERE e.kind = 'CALLS' AND target_qualified IS NOT NULL AND (n.kind IS NULL OR n.kind <> 'File')", graph=True)
def _(t, n, e):
    return G.call_targets(e, n, from_files=False)


@q("c4_edges_among", "SELECT id FROM e WHERE source_qualified IN (SELECT qualified_name FROM n WHERE kind IN ('Class', 'Type')) AND target_qualified IN (SELECT qualified_name FROM n WHERE kind IN ('Class', 'Type'))", graph=True)
def _(t, n, e):
    return G.edges_among(e, n.where("kind in ('Class', 'Type')")).select("id")


@q("c6_helper_tests", "SELECT DISTINCT c.target_qualified AS qualified_name, x.target_qualified AS test FROM e c JOIN e x ON x.source_qualified = c.source_qualified AND x.kind = 'TESTED_BY' JOIN n ON n.qualified_name = x.target_qualified AND n.kind IN ('Test', 'Function') WHERE c.kind = 'CALLS' AND c.target_qualified IS NOT NULL", graph=True)
def _(t, n, e):
    return G.helper_tests(e, n).where("qualified_name is not null")


@q("c10_files_with_symbols", "SELECT file_path FROM n WHERE kind = 'File' AND file_path IN (SELECT file_path FROM n WHERE kind <> 'File')", graph=True)
def _(t, n, e):
    return n.where("kind = 'File'").join(n.where("kind <> 'File'").select("file_path").distinct(), "file_path", "left_semi").select("file_path")


@q("c11_range_overlap", "SELECT DISTINCT n.qualified_name FROM n JOIN (SELECT DISTINCT file_path, line - 2 AS s, line + 2 AS z FROM e WHERE kind = 'REFERENCES') r ON r.file_path = n.file_path AND n.line_start <= r.z AND n.line_end >= r.s", graph=True)
def _(t, n, e):
    r = e.where("kind = 'REFERENCES'").select("file_path", (F.col("line") - 2).alias("start"), (F.col("line") + 2).alias("end")).distinct()
    return G.range_overlap(n, r).select("qualified_name")


@q("c12_enclosing", "SELECT file_path, line, arg_min(qualified_name, (line_end - line_start, qualified_name)) AS enclosing FROM (SELECT DISTINCT file_path, line FROM e WHERE kind = 'CALLS') p JOIN (SELECT file_path, qualified_name, line_start, line_end FROM n WHERE kind IN ('Function', 'Test')) f USING (file_path) WHERE line BETWEEN line_start AND line_end GROUP BY 1, 2", graph=True)
def _(t, n, e):
    return G.enclosing(e.where("kind = 'CALLS'").select("file_path", "line").distinct(), n)


@q("c13_suffix_join", "SELECT DISTINCT x.suffix, f.file_path FROM (SELECT DISTINCT regexp_extract(file_path, '[^/]+/[^/]+$') AS suffix FROM n WHERE kind = 'File') x JOIN (SELECT DISTINCT file_path FROM n WHERE kind = 'File') f ON f.file_path = x.suffix OR ends_with(f.file_path, '/' || x.suffix)", graph=True)
def _(t, n, e):
    f = n.where("kind = 'File'").select("file_path").distinct()
    names = f.select(F.regexp_extract("file_path", "[^/]+/[^/]+$", 0).alias("suffix")).distinct()
    return G.suffix_join(names, f).select("suffix", "file_path")


@q("c15_partial_targets", "SELECT id, list_extract(string_split(target_qualified, '::'), -1) AS name FROM e WHERE kind = 'CALLS' AND contains(target_qualified, '::')", graph=True)
def _(t, n, e):
    return e.where("kind = 'CALLS' and target_qualified like '%::%'").select("id", F.element_at(F.split("target_qualified", "::"), -1).alias("name"))


@q("d0_resolve_targets", graph=True)
def _(t, n, e):
    asked = n.where("kind in ('Class', 'Endpoint')").select(F.col("name").alias("asked")).distinct()
    return P.resolve_targets(n, asked)


_BUILTIN = ", ".join(f"'{x}'" for x in rules.BUILTIN_CALLS)


@q("d1_callers_of", f"SELECT target_qualified AS target, source_qualified AS answer, list_sort(list(DISTINCT line)) AS lines, count(*) AS calls FROM e WHERE kind = 'CALLS' AND target_qualified IS NOT NULL AND target_qualified NOT IN ({_BUILTIN}) AND source_qualified IN (SELECT qualified_name FROM n) GROUP BY 1, 2", graph=True)
def _(t, n, e):
    return P.callers_of(n, e)


@q("d2_references_to", _PAIR.format("'REFERENCES'"), graph=True)
def _(t, n, e):
    return P.sources_of(n, e, ["REFERENCES"])


@q("d3_callees_of", "SELECT source_qualified AS target, target_qualified AS answer, list_sort(list(DISTINCT line)) AS lines, count(*) AS calls FROM e WHERE kind = 'CALLS' AND target_qualified IS NOT NULL AND source_qualified IS NOT NULL GROUP BY 1, 2", graph=True)
def _(t, n, e):
    return P.callees_of(e)


@q("d4_imports_of", "SELECT source_qualified AS target, target_qualified AS answer FROM e WHERE kind = 'IMPORTS_FROM'", graph=True)
def _(t, n, e):
    return e.where("kind = 'IMPORTS_FROM'").select(F.col("source_qualified").alias("target"), F.col("target_qualified").alias("answer"))


@q("d5_importers_of", _PAIR.format("'IMPORTS_FROM'"), graph=True)
def _(t, n, e):
    return P.sources_of(n, e, ["IMPORTS_FROM"])


@q("d6_children_of", _OUT.format("'CONTAINS'", ""), graph=True)
def _(t, n, e):
    return P.targets_of(n, e, ["CONTAINS"])


@q("d7_tests_for", """, d AS (SELECT DISTINCT source_qualified AS target, target_qualified AS answer FROM e WHERE kind = 'TESTED_BY' AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL)
SELECT target, answer, false AS inferred FROM d UNION ALL SELECT f.qualified_name, x.qualified_name, true FROM n f JOIN n x ON x.name = 'test_' || f.name AND (x.kind = 'Test' OR x.is_test) AND array_to_string(string_split(x.file_path, '/')[1:4], '/') = array_to_string(string_split(f.file_path, '/')[1:4], '/') WHERE f.kind = 'Function' AND NOT f.is_test AND (f.qualified_name, x.qualified_name) NOT IN (SELECT (target, answer) FROM d)""", graph=True)
def _(t, n, e):
    return P.tests_for(n, e)


@q("d8_inheritors_of", """, i AS (SELECT DISTINCT target_qualified AS t, source_qualified AS s FROM e WHERE kind IN ('INHERITS', 'IMPLEMENTS') AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL), c AS (SELECT qualified_name, name FROM n WHERE kind IN ('Class', 'Type')), x AS (SELECT qualified_name AS target, s AS answer FROM c JOIN i ON i.t = c.qualified_name)
SELECT target, answer, false AS bare FROM x UNION ALL SELECT c.qualified_name, i.s, true FROM c JOIN i ON i.t = c.name WHERE c.qualified_name NOT IN (SELECT target FROM x)""", graph=True)
def _(t, n, e):
    return P.inheritors_of(n, e)


@q("d9_triggers_of", "SELECT DISTINCT source_qualified AS target, target_qualified AS answer FROM e WHERE kind IN ('TRIGGERS', 'INJECTS') AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL", graph=True)
def _(t, n, e):
    return P.targets_of(n, e, ["TRIGGERS", "INJECTS"], known=False)


@q("d10_triggered_by", "SELECT DISTINCT target_qualified AS target, source_qualified AS answer FROM e WHERE kind IN ('TRIGGERS', 'INJECTS') AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL", graph=True)
def _(t, n, e):
    return P.sources_of(n, e, ["TRIGGERS", "INJECTS"], known=False)


@q("d11_publishers_of", _PAIR.format("'PUBLISHES'"), graph=True)
def _(t, n, e):
    return P.sources_of(n, e, ["PUBLISHES"])


@q("d12_handlers_of", _PAIR.format("'HANDLES'"), graph=True)
def _(t, n, e):
    return P.sources_of(n, e, ["HANDLES"])


@q("d13_endpoints_for", _OUT.format("'HANDLES'", " WHERE kind = 'Endpoint'"), graph=True)
def _(t, n, e):
    return P.targets_of(n, e, ["HANDLES"], node_kind="Endpoint")


@q("d14_consumers_of", "SELECT DISTINCT c.qualified_name AS target, e.source_qualified AS answer FROM (SELECT qualified_name, name FROM n WHERE kind = 'ConfigProperty') c JOIN e ON e.target_qualified IN (c.qualified_name, c.name) AND e.kind IN ('DEPENDS_ON_CONFIG', 'CONSUMES') WHERE e.source_qualified IS NOT NULL", graph=True)
def _(t, n, e):
    return P.config_consumers(n, e)


@q("d15_file_summary", "SELECT file_path AS target, qualified_name AS answer, kind, line_start, line_end FROM n WHERE kind <> 'File'", graph=True)
def _(t, n, e):
    return P.file_summary(n)


@q("d16_calls_by_pair", """SELECT source_qualified, target_qualified, coalesce(list_sort(list(DISTINCT line) FILTER (WHERE string_split(source_qualified, '::')[1] = file_path)), []) AS lines, count(*) FILTER (WHERE NOT coalesce(string_split(source_qualified, '::')[1] = file_path, false)) AS elsewhere,
CASE min(CASE upper(confidence_tier) WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END) WHEN 0 THEN 'AMBIGUOUS' WHEN 1 THEN 'INFERRED' ELSE 'EXTRACTED' END AS tier FROM e WHERE kind = 'CALLS' AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL GROUP BY 1, 2""", graph=True)
def _(t, n, e):
    return P.calls_by_pair(e)


@q("d21_bounded", "SELECT qualified_name, (SELECT count(*) FROM n WHERE kind = 'Class') AS total FROM n WHERE kind = 'Class' ORDER BY qualified_name LIMIT 25", graph=True)
def _(t, n, e):
    return P.bounded(n.where("kind = 'Class'").select("qualified_name"), ["qualified_name"], 25)


_COUNTS = "SELECT 'all' AS key"


@q("g1_stats", """SELECT 'nodes' AS what, 'all' AS key, count(*) AS n FROM n UNION ALL SELECT 'edges', 'all', count(*) FROM e UNION ALL SELECT 'node_kind', kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'files', 'all', count(*) FROM n WHERE kind = 'File' UNION ALL SELECT 'languages', 'all', count(DISTINCT language) FROM n""", graph=True)
def _(t, n, e):
    return G.stats(n, e)


@q("g2_count_by_name", "SELECT name, count(*) AS n FROM n WHERE kind IN ('Function', 'Class') GROUP BY name", graph=True)
def _(t, n, e):
    return n.where("kind in ('Function', 'Class')").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@q("g4_degree", "SELECT qualified_name, count(*) AS degree FROM (SELECT source_qualified AS qualified_name FROM e UNION ALL SELECT target_qualified FROM e) WHERE qualified_name IS NOT NULL GROUP BY 1", graph=True)
def _(t, n, e):
    return G.degree(e)


@q("g6_risk_index", """, c AS (SELECT target_qualified AS qn, count(*) AS c FROM e WHERE kind = 'CALLS' GROUP BY 1), x AS (SELECT source_qualified AS qn, count(*) AS c FROM e WHERE kind = 'TESTED_BY' GROUP BY 1)
SELECT id, qualified_name, round(least(CASE WHEN c.c > 10 THEN 0.3 WHEN c.c > 3 THEN 0.15 ELSE 0 END::double + CASE WHEN x.c > 0 THEN 0 ELSE 0.3 END::double + CASE WHEN regexp_matches(lower(name), 'auth|login|password|token|session|crypt|secret|credential|permission|sql|execute') THEN 0.4 ELSE 0 END::double, 1.0), 4) AS risk_score, coalesce(c.c, 0) AS caller_count, CASE WHEN x.c > 0 THEN 'tested' ELSE 'untested' END AS test_coverage, regexp_matches(lower(name), 'auth|login|password|token|session|crypt|secret|credential|permission|sql|execute')::int AS security_relevant
FROM n LEFT JOIN c ON c.qn = qualified_name LEFT JOIN x ON x.qn = qualified_name WHERE kind IN ('Function', 'Class', 'Test')""", graph=True)
def _(t, n, e):
    return G.risk_index(n, e)


@q("g7_flow_criticality_of_nodes", "SELECT m.node_id, count(*) AS flows, round(sum(f.criticality), 6) AS criticality FROM (SELECT DISTINCT flow_id, node_id FROM flow_memberships WHERE node_id IS NOT NULL) m JOIN flows f ON f.id = m.flow_id GROUP BY 1")
def _(t):
    m = t("flow_memberships").where("node_id is not null").select("flow_id", "node_id").distinct()
    return m.join(t("flows").select(F.col("id").alias("flow_id"), "criticality"), "flow_id").groupBy("node_id").agg(F.count(F.lit(1)).alias("flows"), F.round(F.sum("criticality"), 6).alias("criticality"))


@q("g8_unique_names", "SELECT name FROM n WHERE kind IN ('Function', 'Class') AND NOT is_test GROUP BY name HAVING count(*) = 1", graph=True)
def _(t, n, e):
    return n.where("kind in ('Function', 'Class') and not is_test").groupBy("name").count().where("count = 1").select("name")


@q("g11_layout", """, d AS (SELECT DISTINCT file_path FROM n WHERE kind = 'File'), k AS (SELECT CASE WHEN len(string_split(ltrim(file_path, '/'), '/')) > 4 THEN string_split(ltrim(file_path, '/'), '/')[4] ELSE '.' END AS top_dir, CASE WHEN regexp_matches(lower(list_extract(string_split(file_path, '/'), -1)), '\\.(py|js|jsx|ts|tsx|java|go|rs|rb|php|c|cc|cpp|h|hpp|cs|kt|swift|scala|sh|sql)$') THEN 'code' ELSE 'other' END AS kind FROM d)
SELECT top_dir, kind, count(*) AS files, round(count(*) / sum(count(*)) OVER (PARTITION BY top_dir), 4) AS share FROM k GROUP BY 1, 2""", graph=True)
def _(t, n, e):
    return G.top_dirs(n.where("kind = 'File'").select("file_path").distinct())


@q("g14_fingerprint", "SELECT concat((SELECT count(*) FROM n), ':', (SELECT count(*) FROM e)) AS fingerprint", graph=True)
def _(t, n, e):
    a = n.agg(F.count(F.lit(1)).alias("a"))
    return a.join(e.agg(F.count(F.lit(1)).alias("b"))).select(F.concat_ws(":", "a", "b").alias("fingerprint"))  # two single rows


@q("g18_token_estimate", "SELECT doc_id, cast(ceil(length(text) / 4.0) AS bigint) AS tokens FROM documents WHERE text IS NOT NULL")
def _(t):
    return t("documents").where("text is not null").select("doc_id", F.ceil(F.length("text") / 4.0).alias("tokens"))


@q("o19_upsert_nodes", "SELECT id, qualified_name, ingested_at FROM n", graph=True)
def _(t, n, e):
    return n.select("id", "qualified_name", "ingested_at")


@q("o20_upsert_edges", "SELECT kind, source_qualified, target_qualified, file_path, line, CASE WHEN json_valid(extra) THEN extra ->> '$.receiver' END AS receiver, max(updated_at) AS updated_at FROM e GROUP BY ALL", graph=True)
def _(t, n, e):
    return G.upsert_edges(t("edges")).select("kind", "source_qualified", "target_qualified", "file_path", "line", "receiver", "updated_at")


@q("o23_signatures", "SELECT qualified_name, substr(CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || regexp_replace(coalesce(params, ''), '^\\(|\\)$', '', 'g') || ')' || coalesce(' -> ' || return_type, '') WHEN kind = 'Class' THEN 'class ' || name ELSE name END, 1, 512) AS signature FROM n", graph=True)
def _(t, n, e):
    return n.select("qualified_name", rules.signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type")).alias("signature"))
