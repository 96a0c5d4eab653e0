"""The registered flow queries follow calls to the full depth, against brute force."""

import random
from datetime import datetime as D

import pytest

import __spark_entry__ as entry
from loomgraph.operators import traverse

N = "id bigint, kind string, name string, qualified_name string, file_path string, line_start int, line_end int, language string, parent_name string, params string, return_type string, is_test boolean, extra string, updated_at timestamp, ingested_at timestamp"
E = "id bigint, kind string, source_qualified string, target_qualified string, file_path string, line int, extra string, confidence double, confidence_tier string, updated_at timestamp, ingested_at timestamp"
NOW = D(2025, 1, 1)


@pytest.mark.parametrize("shared", [True, False])
def test_flows_to_the_full_depth(spark, tmp_path, monkeypatch, shared):
    if not shared:  # hops as joins
        monkeypatch.setattr(traverse, "BROADCAST_CALLS", 0)
    rng = random.Random(4)
    name = lambda i: f"/m{i}::f{i}"
    calls = {(i, i + 1) for i in range(25)} | {(30, 31), (31, 0), (31, 7), (12, 3)} | {(rng.randrange(40, 60), rng.randrange(40, 60)) for _ in range(24)}
    ids = sorted({x for c in calls for x in c})
    nodes = [(i, "Function", f"f{i}", name(i), f"/m{i}", 1, 2, "python", None, None, None, False, None, NOW, NOW) for i in ids]
    edges = [(k, "CALLS", name(a), name(b), f"/m{a}", 1, None, 1.0, "EXTRACTED", NOW, NOW) for k, (a, b) in enumerate(sorted(calls))]
    spark.createDataFrame(nodes, N).write.parquet(f"{tmp_path}/nodes.parquet")
    spark.createDataFrame(edges, E).write.parquet(f"{tmp_path}/edges.parquet")

    want = {}
    for start in set(ids) - {b for _, b in calls}:
        seen, front = {start: 0}, [start]
        for k in range(1, 16):
            front = [x for x in {b for a, b in calls if a in front} if x not in seen]
            seen |= dict.fromkeys(front, k)
        if len(seen) > 1:
            want[start] = seen
    assert max(want[30].values()) == 15 and 21 not in want[30]

    got: dict = {}
    for r in entry.queries()["f10_flow_trace"](spark, str(tmp_path)).collect():
        assert got.setdefault(r.entry, {}).setdefault(r.node, r.depth) == r.depth
    assert got == want
    scores = {r.entry: (r.nodes, r.files, r.depth) for r in entry.queries()["f12_criticality"](spark, str(tmp_path)).collect()}
    assert scores == {k: (len(v), len(v), max(v.values())) for k, v in want.items()}
