"""Snapshots of waiting references against brute force over all arrivals and deletions."""

import random
from collections import Counter
from datetime import datetime as D
from datetime import timedelta

from loomgraph.operators import orphans
from test_dealt import FLOWS, MEMBERS, edge, frames


def brute(nodes, edges, graves, ext, members, flows):
    """Walk each reference through the moments of its parent."""
    refs = [("target_qualified", t, "name", made) for _, _, _, t, _, _, _, made, _ in edges]
    refs += [("node_id", i, "id", dict(flows)[f]) for f, i in sorted({(f, i) for f, i, _ in members})]
    out = Counter()
    for field, key, by, made in refs:
        own = [x for x in nodes if x[0 if by == "id" else 1] == key]
        ids, names = {x[0] for x in own}, {x[1] for x in own}
        up, down = {x[2] for x in own}, {d for i, k, d in graves if i in ids or k in names}
        there = lambda t: by == "name" and not own and (key,) in ext or any(x <= t for x in up) and not any(max(x for x in up if x <= t) <= d <= t for d in down)  # noqa: B023,E731
        was, now = True, there(made)
        for t in [made, *sorted(x for x in up | down if x > made)]:
            now = there(t)
            if was != now:
                out[field, f"{t:%Y-%m}", "resolved" if now else "opened"] += 1
                out[field, f"{t:%Y-%m}", "reopened"] += not now and t > made
            was = now
    return +out


def test_snapshots_equal_brute_force(spark):
    rng = random.Random(7)
    at = lambda: D(2025, 1, 1) + timedelta(days=10 * rng.randrange(30))
    nodes = [(i, f"/n{i}", at(), None) for i in range(8) for _ in range(rng.randrange(1, 4))]
    graves = [(rng.choice([i, None]), f"/n{i}" if rng.random() < 0.5 else None, at()) for i in range(10) for _ in range(rng.randrange(3))]
    ext = [("/n8",), ("/n1",)]
    edges = [edge(k, None, f"/n{rng.randrange(11)}", at()) for k in range(60)]
    flows = [(f, at()) for f in range(6)]
    members = [(rng.randrange(6), rng.randrange(11), 0) for _ in range(30)]
    want = brute(nodes, edges, graves, ext, members, flows)
    assert {(f, x) for f, _, x in want} == {(f, x) for f in ("target_qualified", "node_id") for x in ("opened", "reopened", "resolved")}
    for parts in (1, 2):
        state = None
        for p in range(parts):
            cut = lambda x: x[p::parts]  # noqa: B023,E731
            more = spark.createDataFrame(cut(members), MEMBERS), spark.createDataFrame(cut(flows), FLOWS)
            state = orphans.advance(state, *frames(spark, cut(nodes), cut(edges), cut(graves), ext), *more)
        rows = orphans.waiting_snapshots(state).collect()
        got = Counter({(r.ref_field, r.period, x): r[x] for r in rows for x in ("opened", "reopened", "resolved")})
        assert +got == want
        for r in rows:
            assert r.waiting == sum(n * {"opened": 1, "resolved": -1}.get(x, 0) for (f, m, x), n in want.items() if f == r.ref_field and m <= r.period)


def test_increments_give_the_same_orphans_and_counts(spark, monkeypatch):
    monkeypatch.setattr(orphans, "MERGE_AFTER", 3)
    rng = random.Random(11)
    at = lambda: D(2025, 1, 1) + timedelta(days=10 * rng.randrange(30))
    nodes = [(i, f"/n{i}", at(), None) for i in range(8) for _ in range(rng.randrange(1, 4))]
    graves = [(rng.choice([i, None]), f"/n{i}" if rng.random() < 0.5 else None, at()) for i in range(10) for _ in range(rng.randrange(3))]
    edges = [edge(k % 50, None, f"/n{k % 50 % 11}", at()) for k in range(70)]
    flows, members = [(f, at()) for f in range(6)], [(rng.randrange(6), rng.randrange(11), 0) for _ in range(30)]
    results = []
    for parts in (1, 4):
        state = None
        for p in range(parts):
            cut = lambda x: x[p::parts]  # noqa: B023,E731
            more = spark.createDataFrame(cut(members), MEMBERS), spark.createDataFrame(cut(flows), FLOWS)
            state = orphans.advance(state, *frames(spark, cut(nodes), cut(edges), cut(graves), [("/n8",)] if p == 0 else []), *more)
        found = {tuple(r) for r in orphans.orphans(state).collect()}
        results.append((found, {(r.ref_field, r.orphans) for r in orphans.orphan_counts(state).groupBy("ref_field").sum("orphans").withColumnRenamed("sum(orphans)", "orphans").collect()}))
    assert results[0] == results[1]
    assert {f for _, f, _, _ in results[0][0]} == {"target_qualified", "node_id"}
    assert results[0][1] == {(f, sum(x[1] == f for x in results[0][0])) for f in ("target_qualified", "node_id")}


def test_an_increment_reads_the_buckets_it_touches(spark):
    many = [(i, f"/n{i}", D(2025, 1, 1), None) for i in range(400)]
    refs = [edge(i, None, f"/n{i}", D(2025, 2, 1)) for i in range(400)]
    state = orphans.advance(None, *frames(spark, many, refs, [], []))
    key = spark.createDataFrame([(5, "/n5")], "id bigint, qualified_name string")
    touched = orphans.link_rows(key).where("space = 0")
    part = orphans._of(state.refs, touched, orphans.KEY, orphans._buckets(touched))
    assert part.count() == 1
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [bucket" in plan, plan
    state = orphans.advance(state, tombstones=frames(spark, [], [], [(5, None, D(2025, 3, 1))], [])[2])
    assert {r.row_key for r in orphans.orphans(state).collect()} == {"5"}
    state = orphans.advance(state, nodes=frames(spark, [(5, "/n5", D(2025, 4, 1), None)], [], [], [])[1])
    assert orphans.orphans(state).count() == 0
