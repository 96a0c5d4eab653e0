"""Queries of search, vectors, risk and refactoring."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.operators import communities as C
from loomgraph.operators import graph as G
from loomgraph.operators import memory as M
from loomgraph.operators import risk as K
from loomgraph.operators import search as S
from loomgraph.operators import traverse as T
from loomgraph.plans.registry import IGNORED_SQL, Registry
from loomgraph.plans.structure_queries import _DIR
from loomgraph.plans.traverse_queries import TESTS_SQL
from loomgraph.session import materialise

R = Registry()
q = R.add
QUERIES = [(1, "graph parser"), (2, "visible cache window"), (3, "why did the reader fail"), (4, "synchronization of the index")]
_Q = "qs(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in QUERIES) + ")"


def _queries(df):
    return df.sparkSession.createDataFrame(QUERIES, "query_id int, query string")


def _bm25(table: str, key: str, text: str, having: str, extra: str = "", asked: str = "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{L}\\p{N}_]+')) AS term FROM qs") -> str:
    return f"""{_Q}, d AS (SELECT {key} AS doc, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+') AS ts FROM {table} WHERE {text} IS NOT NULL), tt AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM d),
p AS (SELECT doc, len(ts) AS dl, unnest(ts) AS term FROM d), pc AS (SELECT doc, dl, term, count(*) AS tf FROM p GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM pc GROUP BY 1), a AS ({asked}),
g AS (SELECT query_id, doc, round(sum(ln((n - df + 0.5::double) / (df + 0.5::double) + 1) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl))), 4) AS score, count(*) AS terms FROM pc JOIN df USING (term) JOIN a USING (term), tt GROUP BY 1, 2),
r AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM g {having}) {extra}"""


_ALL = "WHERE terms = (SELECT count(*) FROM a WHERE a.query_id = g.query_id)"


@q("i1_bm25", "WITH " + _bm25("documents", "doc_id", "text", _ALL, "SELECT query_id, doc, score, place FROM r WHERE place <= 20"))
def _(t):
    d = t("documents")
    return S.bm25(d, _queries(d))


@q("i2_postings", "SELECT doc_id AS doc, term, count(*) AS tf, dl FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM documents WHERE text IS NOT NULL)) GROUP BY 1, 2, 4")
def _(t):
    return S.postings(t("documents"), "doc_id", "text")


NODE_QUERIES = [(1, "cursor"), (2, "load vector"), (3, "Index.filter"), (4, "merge_symbol"), (5, "PolicyStore"), (6, "resolver qzx")]
_NQ = "qs(query_id, query) AS (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in NODE_QUERIES) + ")"
_WORDS = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_\\-.\\s]+'), lambda x: x <> ''), ' ')"
_SIGNATURE = "substr(CASE WHEN kind IN ('Function', 'Test') THEN 'def ' || name || '(' || regexp_replace(coalesce(params, ''), '^\\(|\\)$', '', 'g') || ')' || coalesce(' -> ' || return_type, '') WHEN kind = 'Class' THEN 'class ' || name ELSE name END, 1, 512)"
_NODE_TEXT = f", nt AS (SELECT id, concat_ws(' ', name, {_WORDS}, qualified_name, {_SIGNATURE}) AS text FROM n), "
_UV = """, uv AS (SELECT id, min(v) AS v FROM (SELECT n.id, x.vector AS v FROM node_vectors x JOIN n ON n.qualified_name = x.qualified_name WHERE x.provider = 'onnx:pocket-mini' AND len(x.vector) = 48 AND len(list_filter(x.vector, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0 AND len(list_filter(x.vector, lambda y: y <> 0)) > 0) GROUP BY id),
an AS (SELECT id, v, row_number() OVER (ORDER BY id) AS query_id FROM uv QUALIFY query_id <= 6),
vr AS (SELECT query_id, doc, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM (SELECT an.query_id, uv.id AS doc, round(list_cosine_similarity(an.v::double[], uv.v::double[]), 6) AS score FROM an, uv)) """


def _node_queries(df):
    return df.sparkSession.createDataFrame(NODE_QUERIES, "query_id bigint, query string")


def _vector_leg(t, n, k):
    """The nearest symbols of six vectors that stand for the embedded queries: those of the least ids."""
    one = S.usable(t("node_vectors").where("provider = 'onnx:pocket-mini'")).join(n.select("id", F.col("qualified_name").alias("name")), "name").select("id", "v")
    vectors = materialise(one, "vectors")
    asked = vectors.orderBy("id").limit(6).select(F.row_number().over(Window.orderBy("id")).cast("bigint").alias("query_id"), "v")
    return S.nearest(vectors, asked.withColumn("query_id", -F.col("query_id")), k, "id", "v").withColumn("query_id", -F.col("query_id"))  # negative ids: the anchors answer too


@q("i3_node_search", _NODE_TEXT + _bm25("nt", "id", "text", _ALL, "SELECT query_id, doc, score, place FROM r WHERE place <= 20").replace(_Q, _NQ), graph=True)
def _(t, n, e):
    return S.bm25(S.node_text(n), _node_queries(n), "id", "text")


@q("i8_vector_leg", _UV + "SELECT query_id, doc, score, place FROM vr WHERE place <= 20", graph=True)
def _(t, n, e):
    return _vector_leg(t, n, 20)


_HYBRID = _UV + _NODE_TEXT + _bm25("nt", "id", "text", _ALL).replace(_Q, _NQ) + """, f AS (SELECT query_id, doc, round(sum(1.0::double / (place + 60)), 9) AS score FROM (SELECT query_id, doc, place FROM r WHERE place <= 60 UNION ALL SELECT query_id, doc, place FROM vr WHERE place <= 60) GROUP BY 1, 2),
i AS (SELECT query_id, query, list_filter(list_concat(list_concat(regexp_extract_all(trim(query), '\\b[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+\\b'), regexp_extract_all(trim(query), '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b')), regexp_extract_all(trim(query), '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b')), lambda w: length(w) >= 3) AS ws FROM qs),
b AS (SELECT query_id, doc, round(score * (CASE WHEN n.kind IN ('Class', 'Type') AND regexp_matches(trim(query), '^[A-Z][a-z]') THEN 1.5::double ELSE 1::double END * CASE WHEN n.kind = 'Function' AND contains(query, '_') THEN 1.5::double ELSE 1::double END * CASE WHEN contains(query, '.') AND contains(lower(qualified_name), lower(query)) THEN 2::double ELSE 1::double END * CASE WHEN len(list_filter(ws, lambda w: contains(lower(qualified_name), lower(w)))) > 0 THEN 2::double ELSE 1::double END), 9) AS score FROM f JOIN n ON n.id = f.doc JOIN i USING (query_id))
SELECT query_id, doc, score, place, CASE WHEN query_id IN (SELECT query_id FROM r) THEN 'hybrid' ELSE 'semantic' END AS mode FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM b) WHERE place <= 20"""


@q("i9_hybrid_search", _HYBRID, graph=True)
def _(t, n, e):
    return S.hybrid(n, _node_queries(n), _vector_leg(t, n, 60))


@q("i4_keyword_nodes", """, qs(query_id, query) AS (VALUES (1, 'parser'), (2, 'get range'), (3, 'merge the session')), qw AS (SELECT *, regexp_split_to_array(query, '\\s+') AS ws FROM qs), qa AS (SELECT *, CASE WHEN len(ws) > 1 AND len(list_filter(ws, lambda w: length(w) > 3)) > 0 THEN list_filter(ws, lambda w: length(w) > 3) ELSE ws END AS ad FROM qw),
c AS (SELECT query_id, query, ws, ad, id, kind, lower(name) AS nm, CASE WHEN len(ws) = 1 THEN lower(qualified_name) WHEN contains(qualified_name, '::') THEN substr(lower(qualified_name), instr(qualified_name, '::') + 2) ELSE substr(lower(qualified_name), 2) END AS sy FROM n, qa),
h AS (SELECT query_id, id AS doc, len(list_filter(ws, lambda w: contains(nm, w) OR contains(sy, w))) * 10 + CASE WHEN nm = query THEN 3::double WHEN starts_with(nm, query) THEN 2::double ELSE 1::double END AS score FROM c WHERE (len(ws) = 1 OR kind <> 'File') AND len(list_filter(ad, lambda w: contains(nm, w) OR contains(sy, w))) > 0)
SELECT query_id, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM h) WHERE place <= 50""", graph=True)
def _(t, n, e):
    return S.keyword_nodes(n, n.sparkSession.createDataFrame([(1, "parser"), (2, "get range"), (3, "merge the session")], "query_id int, query string"))


@q("i7_fusion", _UV + _NODE_TEXT + _bm25("nt", "id", "text", _ALL).replace(_Q, _NQ) + " SELECT query_id, doc, round(sum(1.0::double / (place + 60)), 9) AS score FROM (SELECT query_id, doc, place FROM r WHERE place <= 30 UNION ALL SELECT query_id, doc, place FROM vr WHERE place <= 30) GROUP BY 1, 2", graph=True)
def _(t, n, e):
    """Keyword rank of nodes and vector rank, fused."""
    return S.fuse(S.bm25(S.node_text(n), _node_queries(n), "id", "text", 30), _vector_leg(t, n, 30))


@q("i13_memory_hybrid")
def _(t):
    o = M.memory_filter(M.unique_observations(t("observations")), start="2025-03-01", end="2025-12-31")
    return S.memory_hybrid(o, _queries(o))


@q("i10_memory_search", "WITH o AS (SELECT id, any_value(title || ' ' || coalesce(body, '')) AS text FROM observations GROUP BY id), " + _bm25("o", "id", "text", _ALL, "SELECT query_id, doc, score, place FROM r WHERE place <= 20"))
def _(t):
    o = t("observations").dropDuplicates(["id"]).select("id", F.concat_ws(" ", "title", F.coalesce("body", F.lit(""))).alias("text"))
    return S.bm25(o, _queries(o), "id", "text")


@q("i12_memory_relaxed")
def _(t):
    o = t("observations").dropDuplicates(["id"]).select("id", F.concat_ws(" ", "title", F.coalesce("body", F.lit(""))).alias("text"))
    return S.search_or_relax(o, _queries(o), "id", "text")


@q("i15_grep_rank", "SELECT file_path AS doc, len(string_split(lower(content), 'session')) - 1 + len(string_split(lower(content), 'router')) - 1 AS hits FROM (SELECT DISTINCT file_path, content FROM source_files) WHERE content IS NOT NULL AND (contains(lower(content), 'session') OR contains(lower(content), 'router')) ORDER BY hits DESC, doc LIMIT 10")
def _(t):
    return S.grep_rank(t("source_files").select("file_path", "content").distinct(), ["session", "router"])


_KNN = "SELECT query_id, doc, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE place <= 10"


@q("j2_nearest", _KNN)
def _(t):
    v = t("embeddings")
    return S.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), 10)


@q("j3_nearest_floor", _KNN.replace("place <= 10", "place <= 40 AND score >= 0.25"))
def _(t):
    v = t("embeddings")
    return S.nearest(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), 40, least=0.25)


_EMBED = ", tx AS (SELECT qualified_name, concat_ws(' ', concat_ws('.', parent_name, name), " + _WORDS + ", lower(kind), 'in ' || parent_name, params, 'returns ' || return_type, regexp_extract(file_path, '([^/]+)/[^/]*$', 1), language) AS text FROM n WHERE kind <> 'File') "


@q("j6_embedding_text", _EMBED + "SELECT qualified_name, text, sha256(text) AS text_hash FROM tx", graph=True)
def _(t, n, e):
    return S.embedding_text(n)


@q("j5_stale_texts", _EMBED + "SELECT qualified_name, sha256(text) AS text_hash FROM tx WHERE NOT EXISTS (SELECT 1 FROM node_vectors v WHERE v.qualified_name = tx.qualified_name AND v.provider = 'onnx:pocket-mini' AND v.text_hash = sha256(tx.text))", graph=True)
def _(t, n, e):
    return S.stale_texts(S.embedding_text(n), t("node_vectors"), "onnx:pocket-mini").select("qualified_name", "text_hash")


@q("g3_search_counts", _NODE_TEXT + _bm25("nt", "id", "text", _ALL, "SELECT query_id, count(*) AS nodes FROM r GROUP BY 1").replace(_Q, _NQ), graph=True)
def _(t, n, e):
    return S.bm25(S.node_text(n), _node_queries(n), "id", "text", limit=None).groupBy("query_id").agg(F.count(F.lit(1)).alias("nodes"))


@q("c8_missing_vectors", "SELECT qualified_name FROM n WHERE kind <> 'File' AND qualified_name NOT IN (SELECT qualified_name FROM node_vectors WHERE vector IS NOT NULL)", graph=True)
def _(t, n, e):
    return n.where("kind <> 'File'").join(t("node_vectors").where("vector is not null").select("qualified_name").distinct(), "qualified_name", "left_anti").select("qualified_name")


@q("c9_orphan_vectors", "SELECT DISTINCT provider, qualified_name FROM node_vectors WHERE qualified_name NOT IN (SELECT qualified_name FROM n)", graph=True)
def _(t, n, e):
    return t("node_vectors").select("provider", "qualified_name").distinct().join(n.select("qualified_name"), "qualified_name", "left_anti").select("provider", "qualified_name")


@q("j9_providers", "SELECT provider, len(vector) AS width, count(DISTINCT qualified_name) AS names FROM node_vectors WHERE len(vector) > 0 GROUP BY 1, 2")
def _(t):
    return t("node_vectors").where("size(vector) > 0").groupBy("provider", F.size("vector").alias("width")).agg(F.count_distinct("qualified_name").alias("names"))


_RISK = _DIR + TESTS_SQL + """, tc AS (SELECT qn, count(*) AS c FROM ts GROUP BY 1),
fm AS (SELECT node_id AS id, sum(criticality) AS crit, count(*) AS k FROM (SELECT DISTINCT flow_id, node_id FROM flow_memberships WHERE node_id IS NOT NULL) m JOIN flows f ON f.id = m.flow_id GROUP BY 1),
cl AS (SELECT target_qualified AS qn, count(*) AS c FROM e WHERE kind = 'CALLS' AND target_qualified IS NOT NULL GROUP BY 1),
cr AS (SELECT x.t AS qn, count(*) AS c FROM (SELECT DISTINCT source_qualified AS s, target_qualified AS t FROM e WHERE kind = 'CALLS') x JOIN mm a ON a.qualified_name = x.t JOIN mm b ON b.qualified_name = x.s WHERE a.community <> b.community GROUP BY 1),
rk AS (SELECT n.qualified_name, CASE WHEN fm.crit IS NOT NULL THEN least(fm.crit, 0.25) ELSE least(coalesce(fm.k, 0)::double * 0.05::double, 0.25) END + least(coalesce(cr.c, 0)::double * 0.05::double, 0.15::double) + (0.30::double - least(coalesce(tc.c, 0)::double / 5.0::double, 1.0::double) * 0.25::double) + CASE WHEN regexp_matches(lower(n.name) || ' ' || lower(n.qualified_name), '""" + "|".join(rules.SECURITY) + """') THEN 0.20::double ELSE 0.0::double END + least(coalesce(cl.c, 0)::double / 20.0::double, 0.10::double) + least(coalesce(hu.days, 0)::double / 10.0::double, 1.0::double) * 0.15::double AS s
FROM n LEFT JOIN fm USING (id) LEFT JOIN cl ON cl.qn = n.qualified_name LEFT JOIN cr ON cr.qn = n.qualified_name LEFT JOIN tc ON tc.qn = n.qualified_name LEFT JOIN (SELECT file_path, count(DISTINCT updated_at::date) AS days FROM e GROUP BY 1) hu ON hu.file_path = n.file_path WHERE n.kind IN ('Function', 'Test', 'Class')) """


def _risk(t, n, e):
    return K.risk_scores(n, e, t("flow_memberships"), t("flows"), C.by_directory(n), T.transitive_tests(n, e), K.churn(e))


@q("k1_risk_scores", _RISK + "SELECT qualified_name, round(least(greatest(s, 0), 1), 4) AS risk FROM rk", graph=True)
def _(t, n, e):
    return _risk(t, n, e)


@q("k2_review_priorities", _RISK + "SELECT qualified_name, round(least(greatest(s, 0), 1), 4) AS risk FROM rk WHERE qualified_name IN (SELECT qualified_name FROM n WHERE file_path IN (SELECT file_path FROM n WHERE kind = 'File' AND updated_at >= (SELECT max(updated_at) FROM n) - INTERVAL 180 DAYS)) ORDER BY risk DESC, qualified_name LIMIT 10", graph=True)
def _(t, n, e):
    changed = n.join(T.recent_files(n), "file_path", "left_semi").select("qualified_name")
    return _risk(t, n, e).join(changed, "qualified_name", "left_semi").orderBy(F.desc("risk"), "qualified_name").limit(10)


@q("k3_test_gaps", "SELECT qualified_name FROM n WHERE kind = 'Function' AND NOT is_test AND name NOT IN ('setup', 'teardown', 'constructor', '__init__') AND qualified_name NOT IN (SELECT source_qualified FROM e WHERE kind = 'TESTED_BY' AND source_qualified IS NOT NULL)", graph=True)
def _(t, n, e):
    return K.test_gaps(n, e)


@q("k9_large_functions", ", h AS (SELECT qualified_name, kind, line_end - line_start + 1 AS lines FROM n WHERE kind IN ('Function', 'Test', 'Class') AND line_end - line_start + 1 >= 20 AND NOT " + IGNORED_SQL + ") SELECT *, (SELECT count(*) FROM h) AS matching FROM h ORDER BY lines DESC, qualified_name LIMIT 20", graph=True)
def _(t, n, e):
    return K.large_functions(n)


#: The kinds of events of the test table in place of tools.
_TOOLS = {"reviewing": ("view",), "debugging": ("error",), "refactoring": ("purchase",), "exploring": ("click", "signup")}


@q("k11_intents", """SELECT event_id, CASE WHEN greatest(a, b, c, d) = 0 THEN 'exploring' WHEN a = greatest(a, b, c, d) THEN 'reviewing' WHEN b = greatest(a, b, c, d) THEN 'debugging' WHEN c = greatest(a, b, c, d) THEN 'refactoring' ELSE 'exploring' END AS intent FROM (SELECT event_id, count(*) FILTER (WHERE event_type = 'view') OVER w AS a, count(*) FILTER (WHERE event_type = 'error') OVER w AS b, count(*) FILTER (WHERE event_type = 'purchase') OVER w AS c, count(*) FILTER (WHERE event_type IN ('click', 'signup')) OVER w AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""")
def _(t):
    return K.intents(t("events"), _TOOLS)


@q("g17_churn", "SELECT file_path, count(DISTINCT updated_at::date) AS days FROM e GROUP BY 1", graph=True)
def _(t, n, e):
    return K.churn(e)


@q("l1_dead_code", graph=True)
def _(t, n, e):
    return K.dead_code(n, e)


@q("l2_type_names", "SELECT DISTINCT unnest(regexp_extract_all(concat_ws(' ', params, return_type), '[A-Z][A-Za-z0-9_]*')) AS name FROM n WHERE kind IN ('Function', 'Test')", graph=True)
def _(t, n, e):
    return K.type_names(n)


@q("l3_rename_preview", ", nm AS (SELECT DISTINCT name FROM n WHERE kind = 'Class'), p AS (SELECT n.name, n.file_path, n.line_start AS line, 'definition' AS why FROM n JOIN nm USING (name) UNION ALL SELECT nm.name, u.file_path, u.line, CASE WHEN u.kind = 'IMPORTS_FROM' THEN 'import' ELSE 'use' END FROM (SELECT *, list_extract(regexp_split_to_array(target_qualified, '::|\\.'), -1) AS nx FROM e WHERE kind IN ('CALLS', 'IMPORTS_FROM', 'REFERENCES') AND target_qualified IS NOT NULL) u JOIN nm ON nm.name = u.nx) SELECT name, file_path, line, min(why) AS why FROM p GROUP BY 1, 2, 3", graph=True)
def _(t, n, e):
    return K.rename_preview(n, e, n.where("kind = 'Class'").select("name").distinct())


@q("l4_move_suggestions", _DIR + ", c AS (SELECT x.t AS qn, min(b.community) AS target, max(b.community) AS hi, count(*) AS callers FROM (SELECT DISTINCT source_qualified AS s, target_qualified AS t FROM e WHERE kind = 'CALLS' AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL) x JOIN mm b ON b.qualified_name = x.s GROUP BY 1) SELECT mm.qualified_name, mm.community AS own, c.target, c.callers FROM c JOIN mm ON mm.qualified_name = c.qn WHERE c.target = c.hi AND mm.community <> c.target", graph=True)
def _(t, n, e):
    return K.move_suggestions(e, C.by_directory(n))


_CUT = "(SELECT quantile_disc(ingested_at, 0.5) FROM nodes)"


@q("l6_snapshot_diff", ", a AS (SELECT DISTINCT qualified_name FROM nodes WHERE ingested_at < timestamp '2025-06-01'), z AS (SELECT DISTINCT qualified_name FROM nodes WHERE updated_at >= timestamp '2025-03-01') SELECT 'added' AS change, qualified_name FROM z WHERE qualified_name NOT IN (SELECT qualified_name FROM a) UNION ALL SELECT 'removed', qualified_name FROM a WHERE qualified_name NOT IN (SELECT qualified_name FROM z)", graph=True)
def _(t, n, e):
    return K.snapshot_diff(t("nodes").where("ingested_at < timestamp_ntz '2025-06-01'"), t("nodes").where("updated_at >= timestamp_ntz '2025-03-01'"), "qualified_name")


@q("l6_edge_diff", "WITH a AS (SELECT DISTINCT kind, source_qualified AS s, target_qualified AS t FROM edges WHERE ingested_at < timestamp '2025-06-01'), z AS (SELECT DISTINCT kind, source_qualified, target_qualified FROM edges WHERE updated_at >= timestamp '2025-03-01') SELECT * FROM (SELECT 'added' AS change, count(*) AS n FROM (SELECT * FROM z EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM z)) WHERE n > 0")
def _(t):
    key = ["kind", "source_qualified", "target_qualified"]
    return K.edge_diff(t("edges").where("ingested_at < timestamp_ntz '2025-06-01'"), t("edges").where("updated_at >= timestamp_ntz '2025-03-01'"), key).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@q("p3_file_pairs", ", x AS (SELECT string_split(source_qualified, '::')[1] AS a, string_split(target_qualified, '::')[1] AS b FROM e WHERE source_qualified IN (SELECT qualified_name FROM n) AND target_qualified IN (SELECT qualified_name FROM n)) SELECT a, b, count(*) AS n FROM x WHERE a <> b GROUP BY 1, 2", graph=True)
def _(t, n, e):
    x = G.edges_among(e, n).select(F.substring_index("source_qualified", "::", 1).alias("a"), F.substring_index("target_qualified", "::", 1).alias("b")).where("a <> b")
    return x.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


# A query's name begins with p and a digit only for the eight problems; exports are named x.
for d in (R.queries, R.sql):
    d["x3_file_pairs"] = d.pop("p3_file_pairs")
