"""Orphan references and hot keys, against brute force and on edge cases."""

import random
from datetime import datetime as D

import pytest

from loomgraph.operators import hotkeys, orphans

NODES = "id bigint, qualified_name string, ingested_at timestamp, extra string"
EDGES = "id bigint, kind string, source_qualified string, target_qualified string, file_path string, line int, updated_at timestamp, ingested_at timestamp, k1 string"
GRAVES = "node_id bigint, qualified_name string, deleted_at timestamp"
EXT = "qualified_name string"
FLOWS = "id bigint, created_at timestamp"
MEMBERS = "flow_id bigint, node_id bigint, position int"


def frames(spark, nodes, edges, graves, ext):
    c = spark.createDataFrame
    return c(edges, EDGES), c(nodes, NODES), c(graves, GRAVES), c(ext, EXT)


def edge(i, s, t, made, updated=D(2025, 3, 5)):
    return (i, "CALLS", s, t, "f", 1, updated, made, "clash")


CASE_NODES = [(1, "/a.py::f", D(2025, 1, 1), "{}"), (1, "/a.py::f", D(2025, 6, 1), None), (2, "/b.py::g", D(2025, 4, 1), "{}"), (3, "/c.py::h", D(2025, 1, 1), "{}"), (4, "/d.py::i", D(2025, 5, 1), "{}")]
CASE_GRAVES = [(None, "\\c.py::h", D(2025, 2, 1)), (4, None, D(2025, 4, 1)), (None, None, D(2025, 4, 1))]
CASE_EDGES = [
    edge(10, "/a.py::f", "/b.py::g", D(2025, 3, 1)),  # the target arrives later
    edge(10, "/a.py::f", "/b.py::g", D(2025, 5, 1)),  # delivered again
    edge(11, "\\a.py::f", "/c.py::h", D(2025, 3, 1)),  # the target was deleted
    edge(12, "/a.py::f", "/d.py::i", D(2025, 6, 1)),  # deleted, then made again
    edge(13, "nowhere", None, D(2025, 3, 1)),
    edge(14, "lib::x", "/b.py::g", D(2025, 4, 2)),
    edge(15, "/A.py::f", "lib::x", D(2025, 4, 2)),  # another case is another name
    (None, None, None, None, None, None, None, None, None),
]


def found(state, spark, flows=(), members=()):
    rows = orphans.orphans(state, spark.createDataFrame(list(members), MEMBERS), spark.createDataFrame(list(flows), FLOWS)).collect()
    return {(r.ref_table, r.ref_field, r.period, r.row_key) for r in rows}


WANTED = {("edges", "target_qualified", "2025-03", "10"), ("edges", "target_qualified", "2025-03", "11"), ("edges", "source_qualified", "2025-03", "13"), ("edges", "source_qualified", "2025-03", "15")}


def test_orphans(spark):
    state = orphans.advance(None, *frames(spark, CASE_NODES, CASE_EDGES, CASE_GRAVES, [("lib::x",)]))
    flows = [(1, D(2025, 2, 1)), (2, D(2025, 7, 1))]
    members = [(1, 1, 0), (1, 1, 0), (1, 2, 1), (2, 2, 0), (2, 3, 1), (2, 99, 2), (2, None, 3)]
    assert found(state, spark, flows, members) == WANTED | {("flow_memberships", "node_id", "2025-02", "1:2"), ("flow_memberships", "node_id", "2025-07", "2:3"), ("flow_memberships", "node_id", "2025-07", "2:99")}


def test_increments_equal_one_batch(spark):
    state = None
    for part in (0, 1, 2):
        state = orphans.advance(state, *frames(spark, CASE_NODES[part::3], CASE_EDGES[part::3], CASE_GRAVES[part::3], [("lib::x",)] if part == 1 else []))
    assert found(state, spark) == WANTED


def test_deletion_reopens_and_arrival_resolves(spark):
    s = orphans.advance(None, *frames(spark, CASE_NODES[:1], [edge(1, "/a.py::f", "/a.py::f", D(2025, 3, 1)), edge(2, "/z", "/z", D(2025, 3, 1))], [], []))
    assert {x[3] for x in found(s, spark)} == {"2"}
    s = orphans.advance(s, *frames(spark, [(9, "/z", D(2025, 2, 1), None)], [], [(1, None, D(2025, 8, 1))], []))
    assert {x[3] for x in found(s, spark)} == {"1"}
    snap = {(r.ref_field, r.period): (r.opened, r.resolved, r.waiting) for r in orphans.waiting_snapshots(s).collect()}
    assert snap == {(f, "2025-08"): (1, 0, 1) for f in ("source_qualified", "target_qualified")}  # the month its parent is deleted; /z was there before it was named


def test_orphans_salted_equals_broadcast(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BROADCAST_KEYS", 0)
    assert found(orphans.advance(None, *frames(spark, CASE_NODES, CASE_EDGES, CASE_GRAVES, [("lib::x",)])), spark) == WANTED


def test_orphans_of_empty_tables(spark):
    assert found(orphans.advance(None, *frames(spark, [], [], [], [])), spark) == set()
    assert len(found(orphans.advance(None, *frames(spark, [], CASE_EDGES, [], [])), spark)) == 11


def test_heavy_keys(spark):
    rng = random.Random(1)
    rows = [(i, "k", "hot" if rng.random() < 0.4 else f"t{rng.randrange(400)}", "x") for i in range(3000)]
    rows += rows[:500] + [(None, "k", "hot", "x"), (9000, None, "hot", "x"), (9001, "k", None, "x")]
    df = spark.createDataFrame(rows, "id bigint, kind string, target string, h string")
    ids: dict = {}
    for i, k, t, _ in rows:
        if i is not None and k and t:
            ids.setdefault((k, t), set()).add(i)
    total = len({r[0] for r in rows if r[0] is not None})
    want = {(*k, len(v)) for k, v in ids.items() if len(v) * 100 >= total}
    assert {tuple(r) for r in hotkeys.heavy_keys(df, ["kind", "target"], "id", 0.01).collect()} == want
    assert hotkeys.heavy_keys(df.limit(0), ["kind", "target"], "id", 0.01).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_exact_quantiles(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(hotkeys, "BROADCAST_ROWS", 0)
    rng = random.Random(2)
    data = {"a": [rng.gauss(0, 1e6) for _ in range(900)], "b": [1.0] * 7, "c": [3.0, 1.0, 2.0, 2.0], "d": [-1e300, 0.0, 1e300]}
    rows = [(k, v, vs.count(v)) for k, vs in data.items() for v in set(vs)] + [("z", None, 4)]
    out = hotkeys.exact_quantiles(spark.createDataFrame(rows, "key string, v double, n bigint"), ["key"], "v", "n", [0.1, 0.5, 1.0]).collect()
    import math

    assert {(r.key, r.p): r.q for r in out} == {(k, p): sorted(vs)[max(1, math.ceil(p * len(vs))) - 1] for k, vs in data.items() for p in (0.1, 0.5, 1.0)}


def test_key_profile(spark):
    e = [edge(i, f"/s{i % 3}", "hot", D(2025, 1, 1))[:5] + (i, D(2025, 1, 1), D(2025, 1, 1), "c") for i in range(1, 10)]
    r = hotkeys.key_profile(spark.createDataFrame(e + e, EDGES)).collect()
    assert [(x.edges, x.callers, x.files, x.line_p50, x.line_p90) for x in r] == [(9, 3, 1, 5.0, 9.0)]
    assert hotkeys.key_profile(spark.createDataFrame([], EDGES)).count() == 0
