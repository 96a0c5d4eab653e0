"""Queries of endpoint resolution and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import communities as C
from loomgraph.operators import graph as G
from loomgraph.operators import resolve as E
from loomgraph.plans.registry import Registry
from loomgraph.session import materialise

R = Registry()
q = R.add


def _bare_sql(kind: str, col: str) -> str:
    return f""", im AS (SELECT DISTINCT file_path, string_split(target_qualified, '::')[1] AS f FROM e WHERE kind = 'IMPORTS_FROM' AND target_qualified IS NOT NULL UNION SELECT DISTINCT file_path, file_path FROM e),
b AS (SELECT id, {col} AS name, file_path FROM e WHERE kind = '{kind}' AND {col} IS NOT NULL AND NOT contains({col}, '::') AND NOT contains({col}, '/')),
g AS (SELECT b.id, b.name, count(n.qualified_name) AS nc, count(im.f) AS ne, min(CASE WHEN im.f IS NOT NULL THEN n.qualified_name END) AS one FROM b LEFT JOIN n ON n.name = b.name AND n.kind <> 'File' LEFT JOIN im ON im.file_path = b.file_path AND im.f = n.file_path GROUP BY 1, 2)
SELECT id, name, CASE WHEN ne = 1 THEN 'resolved' WHEN ne > 1 THEN 'ambiguous' WHEN nc > 0 THEN 'unresolved' ELSE 'unknown' END AS status, CASE WHEN ne = 1 THEN one END AS resolved, nc AS n_candidates FROM g"""


@q("e1_bare_call_targets", _bare_sql("CALLS", "target_qualified"), graph=True)
def _(t, n, e):
    return E.resolve_bare(n, e).drop("candidates")


@q("e2_bare_tested_sources", _bare_sql("TESTED_BY", "source_qualified"), graph=True)
def _(t, n, e):
    return E.resolve_bare(n, e, "TESTED_BY", "source_qualified").drop("candidates")


@q("e5_scoped_targets", graph=True)
def _(t, n, e):
    return E.resolve_scopes(n, e)


@q("e6_import_suffixes", graph=True)
def _(t, n, e):
    return E.resolve_imports(n, e)


@q("e7_class_methods", graph=True)
def _(t, n, e):
    return E.resolve_scoped(n, e)


@q("e8_injected_calls", graph=True)
def _(t, n, e):
    return E.injected_calls(n, e)


@q("e9_event_calls", """, p AS (SELECT DISTINCT target_qualified AS event, source_qualified AS publisher FROM e WHERE kind = 'PUBLISHES' AND target_qualified IS NOT NULL AND source_qualified IS NOT NULL), l AS (SELECT DISTINCT target_qualified AS event, source_qualified AS listener FROM e WHERE kind IN ('HANDLES', 'CONSUMES') AND target_qualified IS NOT NULL AND source_qualified IS NOT NULL)
SELECT event, publisher, listener, 0.95::double AS confidence, 'INFERRED' AS tier FROM p JOIN l USING (event) WHERE publisher <> listener""", graph=True)
def _(t, n, e):
    return E.event_calls(e)


@q("e11_local_modules", ", r AS (SELECT e.id, count(*) AS c, min(n.qualified_name) AS one FROM e JOIN n ON n.name = e.target_qualified AND n.kind <> 'File' AND regexp_replace(n.file_path, '/[^/]*$', '') = regexp_replace(e.file_path, '/[^/]*$', '') WHERE e.kind = 'REFERENCES' AND NOT contains(e.target_qualified, '::') AND NOT contains(e.target_qualified, '/') GROUP BY 1) SELECT id, one AS resolved FROM r WHERE c = 1", graph=True)
def _(t, n, e):
    return E.local_modules(n, e)


@q("e12_modules_by_stem", graph=True)
def _(t, n, e):
    return E.modules_by_stem(n, e)


@q("e14_class_index", "SELECT name, qualified_name, file_path FROM n WHERE kind IN ('Class', 'Type')", graph=True)
def _(t, n, e):
    return E.class_index(n)


_CHAIN = """, up AS (SELECT DISTINCT source_qualified AS cls, target_qualified AS ancestor FROM e WHERE kind IN ('INHERITS', 'IMPLEMENTS') AND source_qualified IS NOT NULL AND target_qualified IS NOT NULL),
ch(cls, ancestor, depth) AS (SELECT cls, ancestor, 1 FROM up WHERE cls IN (SELECT qualified_name FROM n WHERE kind IN ('Class', 'Type')) UNION SELECT ch.cls, up.ancestor, ch.depth + 1 FROM ch JOIN up ON up.cls = ch.ancestor WHERE ch.cls <> up.ancestor AND ch.depth < 10), cx AS (SELECT cls, ancestor, min(depth) AS depth FROM ch GROUP BY 1, 2) """


@q("e15_class_chain", _CHAIN + "SELECT cls, ancestor, depth FROM cx", graph=True)
def _(t, n, e):
    return E.class_chain(n, e)


@q("e16_supertype_methods", _CHAIN + """SELECT cls, name, method, depth FROM (SELECT cx.cls, n.name, n.qualified_name AS method, cx.depth, row_number() OVER (PARTITION BY cx.cls, n.name ORDER BY cx.depth, n.qualified_name) AS k FROM cx JOIN n ON n.kind IN ('Function', 'Test') AND n.parent_name IS NOT NULL AND regexp_replace(n.qualified_name, '\\.[^.]*$', '') = cx.ancestor) WHERE k = 1""", graph=True)
def _(t, n, e):
    return E.supertype_methods(n, e)


@q("e17_receiver_admits", graph=True)
def _(t, n, e):
    return E.receiver_admits(n, e)


@q("e19_display_targets", ", r AS (SELECT e.id, n.qualified_name, row_number() OVER (PARTITION BY e.id ORDER BY CASE WHEN n.file_path = e.file_path THEN 0 WHEN regexp_replace(n.file_path, '/[^/]*$', '') = regexp_replace(e.file_path, '/[^/]*$', '') THEN 1 ELSE 2 END, n.qualified_name) AS k FROM e JOIN n ON n.name = e.target_qualified AND n.kind <> 'File' WHERE NOT contains(e.target_qualified, '::') AND NOT contains(e.target_qualified, '/')) SELECT id, qualified_name AS resolved FROM r WHERE k = 1", graph=True)
def _(t, n, e):
    return E.display_targets(n, e)


_DIR = """, dd AS (SELECT qualified_name, string_split(ltrim(file_path, '/'), '/') AS p FROM n WHERE kind <> 'File'),
ct AS (SELECT d, count(*) AS c FROM (SELECT t.d, array_to_string(p[3:least(2 + t.d, len(p) - 1)], '/') AS k FROM dd, range(1, 9) t(d) GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1), dp AS (SELECT coalesce(min(d) FILTER (WHERE c >= 10), max(d)) AS d FROM ct),
mb AS (SELECT qualified_name, array_to_string(p[3:least(2 + dp.d, len(p) - 1)], '/') AS community FROM dd, dp), big AS (SELECT community FROM mb GROUP BY 1 HAVING count(*) >= 2), mm AS (SELECT * FROM mb WHERE community IN (SELECT community FROM big)) """
_COH = """, j AS (SELECT a.community AS ca, b.community AS cb FROM e LEFT JOIN mm a ON a.qualified_name = e.source_qualified LEFT JOIN mm b ON b.qualified_name = e.target_qualified),
i AS (SELECT ca AS community, count(*) AS c FROM j WHERE ca = cb GROUP BY 1), x AS (SELECT community, count(*) AS c FROM (SELECT ca AS community FROM j WHERE ca IS DISTINCT FROM cb UNION ALL SELECT cb FROM j WHERE ca IS DISTINCT FROM cb) WHERE community IS NOT NULL GROUP BY 1),
co AS (SELECT s.community, s.size, coalesce(i.c, 0) AS internal, coalesce(x.c, 0) AS external, CASE WHEN coalesce(i.c, 0) + coalesce(x.c, 0) > 0 THEN round(coalesce(i.c, 0) / (coalesce(i.c, 0) + coalesce(x.c, 0)), 4) ELSE 0 END AS cohesion FROM (SELECT community, count(*) AS size FROM mm GROUP BY 1) s LEFT JOIN i USING (community) LEFT JOIN x USING (community)) """


@q("h3_directories", _DIR + "SELECT qualified_name, community FROM mm", graph=True)
def _(t, n, e):
    return C.by_directory(n)


@q("b16_community_of_names", _DIR + "SELECT x.qualified_name, community FROM (SELECT DISTINCT qualified_name FROM n WHERE kind IN ('Class', 'Type')) x LEFT JOIN mm ON mm.qualified_name = x.qualified_name", graph=True)
def _(t, n, e):
    return G.community_of(C.by_directory(n), n.where("kind in ('Class', 'Type')"))


@q("b18_community_members", _DIR + "SELECT community, list_sort(list(qualified_name)) AS members FROM mm WHERE community IN (SELECT community FROM mm GROUP BY 1 HAVING count(*) <= 50) GROUP BY 1", graph=True)
def _(t, n, e):
    """The members of each small community, as a list."""
    m = C.by_directory(n)
    small = m.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where("n <= 50").select("community")
    return m.join(small, "community", "left_semi").groupBy("community").agg(F.array_sort(F.collect_list("qualified_name")).alias("members"))  # at most fifty


@q("h5_cohesion", _DIR + _COH + "SELECT community, size, internal, external, cohesion FROM co", graph=True)
def _(t, n, e):
    return C.cohesion(C.by_directory(n), e)


@q("h11_communities_sorted", _DIR + _COH + "SELECT community, size, cohesion FROM co WHERE size >= 5 ORDER BY size DESC, cohesion DESC, community", graph=True)
def _(t, n, e):
    return C.cohesion(C.by_directory(n), e).where("size >= 5").select("community", "size", "cohesion").orderBy(F.desc("size"), F.desc("cohesion"), "community")


@q("h4_reassign_tests", _DIR + """, v AS (SELECT x.test, mm.community AS vote, count(*) AS c FROM (SELECT DISTINCT source_qualified AS s, target_qualified AS test FROM e WHERE kind = 'TESTED_BY' AND target_qualified IN (SELECT qualified_name FROM n WHERE is_test OR kind = 'Test')) x JOIN mm ON mm.qualified_name = x.s GROUP BY 1, 2),
w AS (SELECT v.test, v.vote, row_number() OVER (PARTITION BY v.test ORDER BY v.c DESC, coalesce(v.vote <> mm.community, true), v.vote) AS k FROM v LEFT JOIN mm ON mm.qualified_name = v.test) SELECT mm.qualified_name, coalesce(w.vote, mm.community) AS community FROM mm LEFT JOIN w ON w.test = mm.qualified_name AND w.k = 1""", graph=True)
def _(t, n, e):
    return C.reassign_tests(C.by_directory(n), n, e)


@q("h13_overview", _DIR + """, p AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS edges FROM e JOIN mm a ON a.qualified_name = e.source_qualified JOIN mm b ON b.qualified_name = e.target_qualified WHERE coalesce(e.kind, '') <> 'TESTED_BY' AND a.community <> b.community GROUP BY 1, 2)
SELECT a, b, edges, edges > 10 AND NOT regexp_matches(a, '(^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$)') AND NOT regexp_matches(b, '(^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$)') AS warning FROM p""", graph=True)
def _(t, n, e):
    return C.overview(C.by_directory(n), e).drop("top_kinds")


@q("h14_pair_kinds", _DIR + """, p AS (SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, e.kind, count(*) AS n FROM e JOIN mm a ON a.qualified_name = e.source_qualified JOIN mm b ON b.qualified_name = e.target_qualified WHERE coalesce(e.kind, '') <> 'TESTED_BY' AND a.community <> b.community GROUP BY 1, 2, 3),
x AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY n DESC, kind NULLS FIRST) AS k FROM p)
SELECT a, b, sum(n)::bigint AS edges, list(coalesce(kind, '-') ORDER BY k) FILTER (WHERE k <= 3) AS top_kinds FROM x GROUP BY 1, 2""", graph=True)
def _(t, n, e):
    return C.overview(C.by_directory(n), e).drop("warning")


@q("h7_names", graph=True)
def _(t, n, e):
    return C.names(C.by_directory(n), n)


@q("h2_modularity", graph=True)
def _(t, n, e):
    return C.modularity(C.modularity_graph(n, e))


@q("h6_split_oversized", graph=True)
def _(t, n, e):
    g = materialise(C.modularity_graph(n, e), "graph")
    return C.split_oversized(g, materialise(C.modularity(g), "communities"))


@q("q_modularity_score", graph=True)
def _(t, n, e):
    g = materialise(C.modularity_graph(n, e), "graph")
    return C.modularity_score(g, C.modularity(g))


@q("g4_top_symbols", _DIR + """, dg AS (SELECT qualified_name, count(*) AS degree FROM (SELECT source_qualified AS qualified_name FROM e UNION ALL SELECT target_qualified FROM e) GROUP BY 1) SELECT community, qualified_name, degree, place FROM (SELECT community, mm.qualified_name, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, mm.qualified_name) AS place FROM mm LEFT JOIN dg ON dg.qualified_name = mm.qualified_name) WHERE place <= 5""", graph=True)
def _(t, n, e):
    return C.top_symbols(C.by_directory(n), G.degree(e))


@q("h15_top_folders", _DIR + """, fd AS (SELECT mm.community, array_to_string(p[1:least(2, len(p) - 1)], '/') AS folder FROM mm JOIN dd USING (qualified_name)), fc AS (SELECT community, folder, count(*) AS n FROM fd GROUP BY 1, 2),
fs AS (SELECT *, sum(n) OVER (PARTITION BY community) AS total, row_number() OVER (PARTITION BY community ORDER BY n DESC, folder) AS place FROM fc) SELECT community, folder, round(n / total, 4) AS share, place FROM fs WHERE place <= 2""", graph=True)
def _(t, n, e):
    return C.top_folders(C.by_directory(n), n)
