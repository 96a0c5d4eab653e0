"""Queries of memory, maintenance, exports and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.operators import communities as C
from loomgraph.operators import exports as X
from loomgraph.operators import maintain as O
from loomgraph.operators import memory as M
from loomgraph.operators import traverse as T
from loomgraph.plans.registry import Registry
from loomgraph.plans.structure_queries import _DIR

R = Registry()
q = R.add
_O = "WITH o AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, created_at) AS rn FROM observations) WHERE rn = 1) "


def _obs(t):
    return M.unique_observations(t("observations"))


@q("n1_shape", _O + "SELECT id, CASE WHEN length(l) > 120 THEN substr(l, 1, 119) || '…' ELSE l END AS title FROM (SELECT id, trim(regexp_extract(body, '(?m)^[ \\t]*(\\S[^\\n]*)$', 1)) AS l FROM o WHERE length(trim(body, ' ')) >= 16)")
def _(t):
    return M.shape(_obs(t)).select("id", "title")


@q("n2_capture", _O + ", f AS (SELECT session, arg_min(id, (created_at, id)) AS id, min((created_at, id)) AS k FROM o GROUP BY session, doc_type, body) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY session ORDER BY k) AS r FROM f WHERE session IS NOT NULL) WHERE r <= 100")
def _(t):
    return M.capture(_obs(t))


@q("n5_content_ids", _O + "SELECT id, substr(sha256(coalesce(project, '') || chr(1) || coalesce(title, '') || chr(1) || coalesce(body, '')), 1, 16) AS cid FROM o")
def _(t):
    o = _obs(t)
    return o.select("id", F.substring(F.sha2(F.concat_ws("\x01", *[F.coalesce(F.col(c), F.lit("")) for c in ("project", "title", "body")]), 256), 1, 16).alias("cid"))


@q("n6_duplicates", _O + "SELECT session, doc_type, body, count(*) AS n FROM o WHERE body <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(t):
    return _obs(t).where("body <> ''").groupBy("session", "doc_type", "body").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@q("n7_exchanges", _O + ", w AS (SELECT *, sum((lower(trim(kind)) = 'prompt')::int) OVER (PARTITION BY session ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS turn FROM o WHERE session IS NOT NULL) SELECT session, arg_min(id, (created_at, id)) FILTER (WHERE lower(trim(kind)) = 'prompt') AS prompt_id, arg_max(id, (created_at, id)) FILTER (WHERE lower(trim(kind)) <> 'prompt') AS reply_id FROM w WHERE turn > 0 GROUP BY session, turn HAVING count(*) FILTER (WHERE lower(trim(kind)) <> 'prompt') > 0")
def _(t):
    return M.exchanges(_obs(t))


@q("n9_session_stats", _O + "SELECT session, count(*) AS rows, count(*) FILTER (WHERE doc_type = 'prompts') AS prompts, max(created_at) + INTERVAL 30 MINUTES AS settles_at FROM o WHERE session IS NOT NULL GROUP BY 1")
def _(t):
    return M.session_stats(_obs(t)).select("session", "rows", "prompts", "settles_at")


@q("n12_recent_documents", _O + "SELECT session, id, r FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY created_at DESC, id DESC) AS r FROM o WHERE session IS NOT NULL) WHERE r <= 5")
def _(t):
    return M.recent_documents(_obs(t))


@q("n13_latest_session", _O + "SELECT project, arg_max(session, (created_at, id)) AS session FROM o WHERE session IS NOT NULL GROUP BY 1")
def _(t):
    return _obs(t).where("session is not null").groupBy("project").agg(F.max_by("session", F.struct("created_at", "id")).alias("session"))


@q("n15_structural_summary", _O + ", p AS (SELECT session, created_at, id, trim(regexp_extract(CASE WHEN coalesce(title, '') <> '' THEN title ELSE coalesce(body, '') END, '(?m)^[ \\t]*(\\S[^\\n]*)$', 1)) AS l FROM o WHERE session IS NOT NULL AND lower(trim(kind)) = 'prompt'), x AS (SELECT session, CASE WHEN length(l) > 120 THEN substr(l, 1, 119) || '…' ELSE l END AS l, row_number() OVER (PARTITION BY session ORDER BY created_at, id) AS r FROM p) SELECT session, string_agg(r || '. ' || l, chr(10) ORDER BY r) AS summary FROM x GROUP BY 1")
def _(t):
    return M.structural_summary(_obs(t))


@q("c7_unsummarised", _O + "SELECT session, count(*) AS rows, max(created_at) AS last_at FROM o WHERE session IS NOT NULL AND session NOT IN (SELECT session FROM o WHERE lower(trim(kind)) = 'session' AND session IS NOT NULL) GROUP BY 1 HAVING count(*) >= 3 ORDER BY last_at DESC, session LIMIT 20")
def _(t):
    return M.unsummarised(_obs(t))


_SETTLED = ", nw AS (SELECT max(created_at) AS t FROM o), ss AS (SELECT session, count(*) AS rows, max(created_at) AS last_at FROM o WHERE session IS NOT NULL GROUP BY 1) "


@q("n14_pending_summaries", _O + _SETTLED + "SELECT session, rows, last_at FROM ss, nw WHERE rows >= 3 AND last_at + INTERVAL 30 MINUTES <= t AND session NOT IN (SELECT session FROM o WHERE lower(trim(kind)) = 'session' AND session IS NOT NULL) ORDER BY last_at DESC, session LIMIT 3")
def _(t):
    return M.pending_summaries(_obs(t))


@q("o14_waiting_sessions", _O + _SETTLED + "SELECT session, last_at + INTERVAL 30 MINUTES AS settles_at FROM ss, nw WHERE last_at + INTERVAL 30 MINUTES > t")
def _(t):
    return M.waiting_sessions(_obs(t))


@q("n8_best_logs", _O + "SELECT session, platform_source, replies FROM (SELECT session, platform_source, count(*) AS replies, row_number() OVER (PARTITION BY session ORDER BY count(*) DESC, platform_source NULLS FIRST) AS k FROM o WHERE session IS NOT NULL AND lower(trim(kind)) <> 'prompt' GROUP BY 1, 2) WHERE k = 1")
def _(t):
    return M.best_logs(_obs(t))


@q("b30_memory_filter", _O + "SELECT id FROM o WHERE lower(trim(kind)) IN ('note', 'bugfix') AND created_at >= timestamp '2025-03-01' AND created_at < timestamp '2025-08-02'")
def _(t):
    return M.memory_filter(_obs(t), kinds=["note", "bugfix"], start="2025-03-01", end="2025-08-01").select("id")


@q("g9_memory_stats", _O + "SELECT count(*) AS rows, count(DISTINCT project) AS projects, count(DISTINCT session) AS sessions, min(created_at) AS first_at, max(created_at) AS last_at FROM o")
def _(t):
    return _obs(t).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("project").alias("projects"), F.count_distinct("session").alias("sessions"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


@q("g10_session_counts", _O + "SELECT session, doc_type, count(*) AS n FROM o GROUP BY 1, 2")
def _(t):
    return _obs(t).groupBy("session", "doc_type").agg(F.count(F.lit(1)).alias("n"))


@q("o4_replace_files", "SELECT count(*) AS rows FROM nodes WHERE file_path NOT IN (SELECT file_path FROM nodes WHERE ingested_at >= timestamp '2025-09-01') OR ingested_at >= timestamp '2025-09-01'")
def _(t):
    n = t("nodes").where("ingested_at is not null")
    new = n.where("ingested_at >= timestamp_ntz '2025-09-01'")
    return O.replace_files(n, new, new).agg(F.count(F.lit(1)).alias("rows"))


@q("o4_changed_hashes", "SELECT DISTINCT s.file_path FROM source_files s WHERE (s.file_path, s.file_hash) NOT IN (SELECT (file_path, file_hash) FROM nodes WHERE file_hash IS NOT NULL)")
def _(t):
    return O.changed_hashes(t("nodes"), t("source_files"))


@q("o6_stale_files", "SELECT DISTINCT file_path FROM n WHERE file_path NOT IN (SELECT file_path FROM source_files)", graph=True)
def _(t, n, e):
    return O.stale_files(n, t("source_files"))


@q("o11_purge_edges", ", g AS (SELECT DISTINCT file_path FROM n WHERE qualified_name IN (SELECT qualified_name FROM node_tombstones)), qn AS (SELECT qualified_name FROM n WHERE file_path IN (SELECT file_path FROM g)) SELECT id FROM e WHERE file_path NOT IN (SELECT file_path FROM g) AND coalesce(source_qualified, '') NOT IN (SELECT qualified_name FROM qn) AND coalesce(target_qualified, '') NOT IN (SELECT qualified_name FROM qn)", graph=True)
def _(t, n, e):
    files = n.join(t("node_tombstones").select("qualified_name").distinct(), "qualified_name", "left_semi").select("file_path").distinct()
    return O.purge(n, e, t("node_vectors"), files)[1].select("id")


@q("o16_rebase", "SELECT id, CASE WHEN starts_with(qualified_name, '/srv/checkouts/') THEN '/data' || substr(qualified_name, 15) ELSE qualified_name END AS qualified_name FROM n", graph=True)
def _(t, n, e):
    return O.rebase(n, "/srv/checkouts", "/data").select("id", "qualified_name")


@q("m7_budget", ", x AS (SELECT id, qualified_name, sum(greatest(ceil(length(qualified_name) / 4.0), 1)) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM n) SELECT id, cast(used AS bigint) AS used FROM x WHERE used <= 4000", graph=True)
def _(t, n, e):
    return O.fits(n.select("id", "qualified_name"), ["id"], "qualified_name", 4000).select("id", F.col("used").cast("bigint").alias("used"))


@q("m9_compact_rows", "SELECT concat_ws('|', kind, name, concat_ws(':', file_path, line_start)) AS value FROM n", graph=True)
def _(t, n, e):
    return X.compact_rows(n)


@q("m11_relative_paths", "SELECT DISTINCT regexp_replace(file_path, '^/srv/checkouts/', '') AS path FROM n", graph=True)
def _(t, n, e):
    return n.select(O.relativise(F.col("file_path"), "/srv/checkouts").alias("path")).distinct()


@q("x2_super_nodes", _DIR + "SELECT coalesce(mm.community, 'Uncategorized') AS community, count(*) AS symbols FROM n LEFT JOIN mm USING (qualified_name) WHERE n.kind <> 'File' GROUP BY 1", graph=True)
def _(t, n, e):
    return X.super_nodes(C.by_directory(n), n)


@q("x6_json", graph=True)
def _(t, n, e):
    return X.json_rows(n)


@q("x7_graphml", "SELECT 'node' AS part, '<node id=\"' || replace(replace(replace(replace(qualified_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '\"><data key=\"kind\">' || kind || '</data></node>' AS value FROM n UNION ALL SELECT 'edge', '<edge source=\"' || replace(source_qualified, '&', '&amp;') || '\" target=\"' || replace(target_qualified, '&', '&amp;') || '\"><data key=\"kind\">' || coalesce(kind, '') || '</data></edge>' FROM e WHERE source_qualified IN (SELECT qualified_name FROM n) AND target_qualified IN (SELECT qualified_name FROM n)", graph=True)
def _(t, n, e):
    from loomgraph.operators.graph import edges_among

    return X.graphml_rows(n, edges_among(e, n))


@q("x8_cypher", graph=True)
def _(t, n, e):
    return X.cypher_rows(n, e.where("source_qualified is not null and target_qualified is not null"))


@q("x11_wiki", graph=True)
def _(t, n, e):
    from loomgraph.operators.graph import degree

    m = C.by_directory(n)
    return X.wiki_rows(m, C.top_symbols(m, degree(e)), X.super_nodes(m, n))


@q("q1_precision_recall", ", p AS (SELECT DISTINCT file_path AS g, string_split(target_qualified, '::')[1] AS i FROM e WHERE kind = 'CALLS' AND target_qualified LIKE '/%'), a AS (SELECT DISTINCT file_path AS g, string_split(target_qualified, '::')[1] AS i FROM e WHERE kind = 'IMPORTS_FROM' AND target_qualified LIKE '/%'), j AS (SELECT coalesce(p.g, a.g) AS g, count(p.g) AS np, count(a.g) AS na, count(*) FILTER (WHERE p.g IS NOT NULL AND a.g IS NOT NULL) AS b FROM p FULL JOIN a ON p.g = a.g AND p.i = a.i GROUP BY 1), s AS (SELECT g, CASE WHEN np > 0 THEN b / np ELSE 0 END AS pr, CASE WHEN na > 0 THEN b / na ELSE 0 END AS rc FROM j) SELECT g, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END, 6) AS f1 FROM s", graph=True)
def _(t, n, e):
    real = e.where("target_qualified like '/%'").select("kind", F.col("file_path").alias("g"), F.substring_index("target_qualified", "::", 1).alias("i"))
    return X.precision_recall(real.where("kind = 'CALLS'"), real.where("kind = 'IMPORTS_FROM'"), "g", "i")


@q("q2_reciprocal_rank", ", r AS (SELECT file_path AS g, qualified_name AS i, row_number() OVER (PARTITION BY file_path ORDER BY line_start, qualified_name) AS k FROM n WHERE kind <> 'File'), h AS (SELECT g, min(k) AS k FROM r WHERE i IN (SELECT source_qualified FROM e WHERE kind = 'TESTED_BY') GROUP BY 1) SELECT round(avg(coalesce(1.0 / h.k, 0)), 6) AS mrr FROM (SELECT DISTINCT g FROM r) x LEFT JOIN h USING (g)", graph=True)
def _(t, n, e):
    w = Window.partitionBy("g").orderBy("line_start", "i")  # the symbols of a file
    ranked = n.where("kind <> 'File'").select(F.col("file_path").alias("g"), F.col("qualified_name").alias("i"), "line_start").withColumn("k", F.row_number().over(w))
    right = ranked.join(e.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("i")).distinct(), "i", "left_semi").select("g", "i")
    return X.reciprocal_rank(ranked.select("g", "i", "k"), right, "g", "i", "k")


@q("q4_impact_accuracy", graph=True)
def _(t, n, e):
    files = T.recent_files(n)
    hit = T.impact(n, e, files).select(F.lit("change").alias("g"), F.col("file_path").alias("i"))
    truth = T.neighbour_files(e).join(files.withColumnRenamed("file_path", "file"), "file", "left_semi").select(F.lit("change").alias("g"), F.col("neighbour").alias("i"))
    return X.precision_recall(hit, truth, "g", "i")


@q("q9_token_ratio", "SELECT s.language, round(median(length(content) / 4.0), 4) AS median_tokens, round(avg(length(content) / 4.0), 4) AS mean_tokens FROM source_files s WHERE content IS NOT NULL GROUP BY 1")
def _(t):
    return t("source_files").where("content is not null").groupBy("language").agg(F.round(F.percentile(F.length("content") / 4.0, F.lit(0.5)), 4).alias("median_tokens"), F.round(F.avg(F.length("content") / 4.0), 4).alias("mean_tokens"))
