"""The graph operators on small hand-made graphs."""

import re
from datetime import datetime as D

import pytest

from loomgraph.functions import rules
from loomgraph.operators import communities, graph, patterns, resolve, risk, search, traverse

N = "id bigint, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, params string, return_type string, is_test boolean, extra string, updated_at timestamp, ingested_at timestamp"
E = "id bigint, kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, confidence double, confidence_tier string, updated_at timestamp, ingested_at timestamp"
NOW = D(2025, 1, 1)


@pytest.fixture
def make(spark):
    def build(edges, names=None, extra=None):
        found = names or sorted({x for _, s, t in edges for x in (s, t)})
        files = sorted({x.split("::")[0] for x in found})
        rows = [(100 + i, "File", f, f, f, 1, 99, "python", None, None, None, False, None, NOW, NOW) for i, f in enumerate(files)]
        rows += [(i, "Function", x.split("::")[-1].split(".")[-1], x, x.split("::")[0], i * 10, i * 10 + 5, "python", None, None, None, False, (extra or {}).get(x), NOW, NOW) for i, x in enumerate(x for x in found if "::" in x)]
        es = [(i, k, s, t, s.split("::")[0], i, None, 1.0, "EXTRACTED", NOW, NOW) for i, (k, s, t) in enumerate(edges)]
        return spark.createDataFrame(rows, N), spark.createDataFrame(es, E)

    return build


def test_latest_nodes_and_unique_edges(spark):
    rows = [(1, "Function", n, "/a::f", "/a", 1, 2, None, None, None, None, False, None, NOW, D(2025, m, 1)) for n, m in (("old", 1), ("new", 3), ("new", 3), ("mid", 2))]
    assert [r.name for r in graph.latest_nodes(spark.createDataFrame(rows, N)).collect()] == ["new"]
    es = [(1, "CALLS", "\\a\\b::f\\g", None, "/a", 1, '{"receiver": ', None, None, NOW, D(2025, m, 1)) for m in (1, 2)]
    e = graph.unique_edges(spark.createDataFrame(es, E)).collect()
    assert [(r.source_qualified, r.target_qualified) for r in e] == [("/a/b::f\\g", None)]


def test_impact_follows_best_path(spark, make):
    n, e = make([("CALLS", "/d::d", "/c::c"), ("CALLS", "/c::c", "/b::b"), ("CALLS", "/b::b", "/a::a")])
    hit = traverse.impact(n, e, spark.createDataFrame([("/a",)], "file_path string"))
    assert {(r.qualified_name, r.score, r.direct) for r in hit.collect()} == {("/b::b", 0.6, True), ("/c::c", 0.36, False)}
    n, e = make([("IMPORTS_FROM", "/t::t", "/s::s"), ("CALLS", "/m::m", "/s::s"), ("CALLS", "/t::t", "/m::m"), ("CONTAINS", "/x::x", "/s::s"), ("TESTED_BY", "/s::s", "/q::q")])
    hit = {r.qualified_name: r.score for r in traverse.impact(n, e, spark.createDataFrame([("/s",)], "file_path string")).collect()}
    assert hit == {"/t::t": 0.36, "/m::m": 0.6, "/q::q": 0.42}


def test_impact_floor_stops_a_chain(spark, make):
    n, e = make([("CALLS", f"/f{i + 1}::f", f"/f{i}::f") for i in range(8)])
    hit = traverse.impact(n, e, spark.createDataFrame([("/f0",)], "file_path string"), depth=8)
    assert {r.qualified_name for r in hit.collect()} == {f"/f{i}::f" for i in range(1, 6)}


def test_flows_and_cycles(make):
    n, e = make([("CALLS", "/a::main", "/b::x"), ("CALLS", "/b::x", "/b::y"), ("CALLS", "/b::y", "/b::x"), ("CALLS", "/b::y", "ghost")])
    n = n.where("qualified_name <> 'ghost'")
    eps = traverse.entry_points(n, e)
    assert [r.qualified_name for r in eps.collect()] == ["/a::main"]
    f = traverse.trace_flows(n, e, eps)
    assert sorted(r.depth for r in f.collect()) == [0, 1, 2]
    c = traverse.criticality(n, e, eps).collect()[0]
    assert (c.nodes, c.files, c.depth) == (3, 2, 2)
    assert c.criticality == round(0.30 * 0.25 + 0.20 * 0.2 + 0.15 + 0.10 * 0.2, 4)


def test_bare_targets_need_one_piece_of_evidence(make):
    names = ["/a::f", "/b::g", "/c::g", "/d::h", "/e::h"]
    n, e = make([("CALLS", "/a::f", "g"), ("IMPORTS_FROM", "/a::f", "/b"), ("CALLS", "/a::f", "h"), ("CALLS", "/a::f", "nothing")], names)
    r = {x.name: (x.status, x.resolved, x.n_candidates) for x in resolve.resolve_bare(n, e).collect()}
    assert r == {"g": ("resolved", "/b::g", 2), "h": ("unresolved", None, 2), "nothing": ("unknown", None, 0)}
    once = resolve.apply_resolution(e, resolve.resolve_bare(n, e))
    assert resolve.resolve_bare(n, once).where("resolved is not null").count() == 0
    assert once.where("raw_target_qualified = 'g'").first().target_qualified == "/b::g"


def test_class_chain_ends_in_cycles(make):
    n, e = make([("INHERITS", "/a::A", "/b::B"), ("INHERITS", "/b::B", "/c::C"), ("INHERITS", "/c::C", "/a::A")])
    from pyspark.sql import functions as F

    n = n.withColumn("kind", F.when(F.col("kind") == "Function", "Class").otherwise(F.col("kind")))
    assert {(r.cls, r.ancestor, r.depth) for r in resolve.class_chain(n, e).collect()} == {("/a::A", "/b::B", 1), ("/a::A", "/c::C", 2), ("/b::B", "/c::C", 1), ("/b::B", "/a::A", 2), ("/c::C", "/a::A", 1), ("/c::C", "/b::B", 2)}


def test_dead_code(make):
    n, e = make([("CALLS", "/a::used_by", "/b::used"), ("CALLS", "/a::main", "bare_one")], ["/a::main", "/a::used_by", "/b::used", "/b::bare_one", "/b::lost", "/b::decorated"], {"/b::decorated": '{"decorators": ["app.get"]}'})
    assert {r.qualified_name for r in risk.dead_code(n, e).collect()} == {"/a::used_by", "/b::lost"}


def test_cohesion_and_modularity(spark, make):
    tri = [("CALLS", f"/{d}/x::{d}{i}", f"/{d}/x::{d}{j}") for d in "pq" for i, j in ((1, 2), (2, 3), (3, 1))] + [("CALLS", "/p/x::p1", "/q/x::q1")]
    n, e = make(tri)
    m = communities.by_directory(n)
    c = {r.community: (r.internal, r.external, r.cohesion) for r in communities.cohesion(m, e).collect()}
    assert c == {"p": (3, 1, 0.75), "q": (3, 1, 0.75)}
    g = communities.modularity_graph(n, e)
    got = {r.id: r.community for r in communities.modularity(g).collect()}
    ids = {r.name: r.id for r in n.where("kind = 'Function'").collect()}
    assert len({got[ids[f"p{i}"]] for i in (1, 2, 3)}) == 1 and got[ids["p1"]] != got[ids["q1"]]


def test_search_relaxes_and_fuses(spark):
    d = spark.createDataFrame([(1, "the cache of the parser"), (2, "parser parser"), (3, None), (4, "nothing")], "doc_id int, text string")
    qs = spark.createDataFrame([(1, "parser cache"), (2, "why did the parser zebra")], "query_id int, query string")
    r = {(x.query_id, x.doc): x.relaxed for x in search.search_or_relax(d, qs, "doc_id", "text").collect()}
    assert r == {(1, 1): False, (2, 1): True, (2, 2): True}
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query_id int, doc int, place int")
    assert search.fuse(a, a).orderBy("doc").first().score == round(2 / 61, 9)


def test_query_rules(spark):
    cases = [("who calls Context.next or so", "Class", "/a::Context.next", 2.0), ("get_users", "Function", "/a::get_users", 3.0), ("get_users", "Class", "/a::x", 1.0), ("ApiRoute", "Class", "/a::ApiRoute", 3.0), ("a.b", "Function", "/a::A.B", 4.0), ("", "Class", "/a::x", 1.0)]
    df = spark.createDataFrame([c[:3] for c in cases], "q string, kind string, qn string")
    assert [r[0] for r in df.select(search.boost(df.q, df.kind, df.qn)).collect()] == [c[3] for c in cases]
    for path, hit in {"build/a.c": True, "src/build/a.c": False, "dist": True, "a/node_modules/x.js": True, "src/vendored/x.go": False, "x/vendor": True, "a/b.min.js": True, "package-lock.json": True, "a/package-lock.json": False, "public/build/m.js": True, "web/public/build/m.js": False, "t.d.ts": True}.items():
        assert any(re.search(rules.glob_regex(g), path) for g in rules.IGNORED_GLOBS + rules.DECLARATION_GLOBS) == hit, path


def test_lookups(spark, make):
    n, e = make([("CALLS", "/a::f", "/b::g"), ("CALLS", "/a::f", "/b::g")])
    r = patterns.callers_of(n, e).collect()
    assert [(x.target, x.answer, x.calls) for x in r] == [("/b::g", "/a::f", 2)]
    asked = spark.createDataFrame([("g",), ("zzz",)], "asked string")
    assert {(x.asked, x.status) for x in patterns.resolve_targets(n, asked).collect()} == {("g", "ok"), ("zzz", "not_found")}
    p = spark.createDataFrame([("/b", 12)], "file_path string, line int")
    assert [x.enclosing for x in graph.enclosing(p, n).collect()] == ["/b::g"]


def test_hybrid_search_fuses_and_falls_back(spark, make):
    n, e = make([("CALLS", "/a::load_cache", "/b::save_cache"), ("CALLS", "/b::Cache.load", "/c::other")])
    qs = spark.createDataFrame([(1, "load_cache"), (2, "cach"), (3, "zzz"), (4, "nowords")], "query_id bigint, query string")
    ids = {r.qualified_name: r.id for r in n.collect()}
    by_vector = spark.createDataFrame([(1, ids["/b::save_cache"], 1), (4, ids["/c::other"], 1)], "query_id bigint, doc bigint, place int")
    got = {}
    for r in search.hybrid(n, qs, by_vector).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append((r.doc, r.mode))
    assert got[1] == [(ids["/a::load_cache"], "hybrid"), (ids["/b::save_cache"], "hybrid")]
    assert {m for _, m in got[2]} == {"keyword"} and len(got[2]) == 3 and 3 not in got and got[4] == [(ids["/c::other"], "semantic")]
    only = search.hybrid(n, qs, by_vector, kind="File").collect()
    assert not [r for r in only if r.query_id == 1]
