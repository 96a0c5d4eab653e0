"""Traversals: impact of changes, tests, entry points, flows and their criticality, dependents.

Each hop of a loop is one join and one aggregation over all seeds at once; its result is written to the shared folder, so that
plans do not grow and a lost executor costs one hop. Nodes travel as 64-bit ids where the result is about nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.names import path_of
from loomgraph.session import materialise

DECAY, FLOOR, IMPACT_DEPTH, FLOW_DEPTH = 0.6, 0.05, 2, 15
#: Entry points whose flows share a row: eight words of 64 bits.
WORDS = 8
BLOCK_BITS = 64 * WORDS
#: Pairs of caller and callee up to this number are sent to the tasks (12 bytes each, at most 24 MB).
BROADCAST_CALLS = 2_000_000
_ANY = " | ".join(f"n{i}" for i in range(WORDS)) + " <> 0"


def impact_edges(e: DataFrame) -> DataFrame:
    """(source, dependent, w): the direction in which a change spreads; tests depend on what they test, containment does not spread."""
    out = F.col("kind") == "TESTED_BY"
    e = e.where("source_qualified is not null and target_qualified is not null and coalesce(kind, '') <> 'CONTAINS'")
    a, b = F.coalesce(out, F.lit(False)), rules.weight(F.col("kind"), rules.IMPACT_WEIGHTS)
    d = e.select(F.when(a, F.col("source_qualified")).otherwise(F.col("target_qualified")).alias("source"), F.when(a, F.col("target_qualified")).otherwise(F.col("source_qualified")).alias("dependent"), b.alias("w"))
    return d.groupBy("source", "dependent").agg(F.max("w").alias("w"))


def bridge_seeds(n: DataFrame, e: DataFrame, seeds: DataFrame) -> DataFrame:
    """Methods of supertypes that methods of the changed classes override."""
    inh = e.where("kind in ('INHERITS', 'IMPLEMENTS')").select(F.col("source_qualified").alias("child"), F.col("target_qualified").alias("parent"))
    m = n.where("kind in ('Function', 'Test') and parent_name is not null").select("qualified_name", "name", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("cls"))
    mine = m.join(seeds.select("qualified_name"), "qualified_name", "left_semi").select(F.col("cls").alias("child"), "name")
    over = mine.join(inh, "child").select("parent", "name").join(m.select(F.col("cls").alias("parent"), "name", "qualified_name"), ["parent", "name"])
    return over.select("qualified_name").distinct().join(seeds.select("qualified_name"), "qualified_name", "left_anti")


def impact(n: DataFrame, e: DataFrame, changed_files: DataFrame, depth: int = IMPACT_DEPTH) -> DataFrame:
    """(qualified_name, score, direct): what a change of files may break. A hop multiplies by the weight of the edge and DECAY; the best score of a node counts, above FLOOR; direct is what the first hop reached.

    Names without a node carry scores on but are no result. changed_files(file_path)."""
    seeds = n.join(changed_files.select("file_path").distinct(), "file_path", "left_semi").select("qualified_name")
    bridges = bridge_seeds(n, e, seeds)
    links = impact_edges(e)
    best = materialise(seeds.select("qualified_name", F.lit(1.0).alias("score"), F.lit(False).alias("direct"), F.lit(True).alias("seed")).unionByName(bridges.select("qualified_name", F.lit(1.0).alias("score"), F.lit(True).alias("direct"), F.lit(False).alias("seed"))), "best")
    front = best.select("qualified_name", "score")
    for hop in range(depth):
        reached = front.join(links, F.col("qualified_name") == F.col("source")).groupBy(F.col("dependent").alias("qualified_name")).agg(F.max(F.col("score") * F.col("w") * F.lit(DECAY)).alias("new")).where(F.col("new") > FLOOR)
        merged = best.join(reached, "qualified_name", "full")
        better = F.col("new") > F.coalesce("score", F.lit(0.0))
        step = materialise(merged.select("qualified_name", F.greatest("score", "new").alias("score"), (F.coalesce("direct", F.lit(False)) | (F.coalesce(better, F.lit(False)) & F.lit(hop == 0))).alias("direct"), F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce(better, F.lit(False)).alias("_new")), "best")
        best, front = step.drop("_new"), step.where("_new").select("qualified_name", "score")
    real = n.select("qualified_name", "file_path", "kind")
    return best.where("not seed").join(real, "qualified_name").select("qualified_name", "kind", "file_path", F.round("score", 4).alias("score"), "direct")


def impact_totals(hit: DataFrame) -> DataFrame:
    """(file_path, items, direct): impacted symbols per file."""
    return hit.groupBy("file_path").agg(F.count(F.lit(1)).alias("items"), F.sum(F.col("direct").cast("long")).alias("direct"))


def impact_reasons(e: DataFrame, seeds: DataFrame, hit: DataFrame) -> DataFrame:
    """(qualified_name, kind, via): for each direct dependent the strongest edge that ties it to a seed."""
    out = e.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("via"), F.col("target_qualified").alias("qualified_name"), "kind")
    into = e.where("coalesce(kind, '') not in ('TESTED_BY', 'CONTAINS')").select(F.col("target_qualified").alias("via"), F.col("source_qualified").alias("qualified_name"), "kind")
    links = out.unionByName(into).join(seeds.select(F.col("qualified_name").alias("via")), "via", "left_semi").join(hit.where("direct").select("qualified_name"), "qualified_name", "left_semi")
    w = rules.weight(F.col("kind"), rules.IMPACT_WEIGHTS)
    return links.groupBy("qualified_name").agg(F.min(F.struct((-w).alias("o"), F.coalesce("kind", F.lit("")).alias("kind"), "via")).alias("b")).select("qualified_name", "b.kind", "b.via")


def owners(n: DataFrame, e: DataFrame) -> DataFrame:
    """(owner, qualified_name): each node with itself, classes with what they contain, files with their classes and functions."""
    own = n.select(F.col("qualified_name").alias("owner"), "qualified_name")
    classes = n.where("kind = 'Class'").select(F.col("qualified_name").alias("source_qualified"))
    held = e.where("kind = 'CONTAINS' and target_qualified is not null").join(classes, "source_qualified").select(F.col("source_qualified").alias("owner"), F.col("target_qualified").alias("qualified_name"))
    files = n.where("kind = 'File'").select("file_path", F.col("qualified_name").alias("owner"))
    symbols = n.where("kind in ('Class', 'Function', 'Method')").select("file_path", "qualified_name").join(files, "file_path").select("owner", "qualified_name")
    return own.unionByName(held).unionByName(symbols).distinct()


def transitive_tests(n: DataFrame, e: DataFrame, depth: int = 1) -> DataFrame:
    """(qualified_name, test, hops): tests of each node by its own edges or those of its members, for classes and files (0), else through what these call, up to `depth` hops; the fewest hops count. Tests without a record are none."""
    real = n.select(F.col("qualified_name").alias("test"))
    tested = e.where("kind = 'TESTED_BY' and source_qualified is not null and target_qualified is not null").select(F.col("source_qualified").alias("qualified_name"), F.col("target_qualified").alias("test")).distinct().join(real, "test", "left_semi").select("qualified_name", "test")
    calls = e.where("kind = 'CALLS' and source_qualified is not null and target_qualified is not null").select(F.col("source_qualified").alias("caller"), F.col("target_qualified").alias("qualified_name")).distinct()
    out, level = tested.withColumn("hops", F.lit(0)), tested
    for k in range(1, depth + 1):
        level = calls.join(level, "qualified_name").select(F.col("caller").alias("qualified_name"), "test").distinct()
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
        if k < depth:
            level = materialise(level, "tests")
    return owners(n, e).join(out, "qualified_name").groupBy(F.col("owner").alias("qualified_name"), "test").agg(F.min("hops").alias("hops"))


def entry_points(n: DataFrame, e: DataFrame, include_tests: bool = False) -> DataFrame:
    """Functions where flows begin: never called (calls from the top level of a file aside), or called by a framework, by decorator or name."""
    files = n.where("kind = 'File'").select(F.col("qualified_name").alias("source_qualified"))
    called = e.where("kind = 'CALLS' and target_qualified is not null").join(files, "source_qualified", "left_anti").select(F.col("target_qualified").alias("qualified_name"), F.lit(True).alias("called")).distinct()
    flags = n.where("kind = 'File'").select("file_path", F.col("is_test").alias("test_file"))
    f = n.where("kind in ('Function', 'Test')").join(flags, "file_path", "left").join(called, "qualified_name", "left")
    if not include_tests:
        f = f.where(~F.col("is_test") & ~F.coalesce("test_file", F.lit(False)))
    return f.where(F.col("called").isNull() | rules.framework_decorator(F.col("extra")) | rules.entry_name(F.col("name"), F.col("language"))).select("id", "qualified_name", "name", "kind", "file_path")


def call_ids(n: DataFrame, e: DataFrame) -> DataFrame:
    """(src, dst): calls between nodes, by id."""
    s = n.select(F.col("id").alias("src"), F.col("qualified_name").alias("source_qualified"))
    t = n.where("kind in ('Function', 'Test', 'Class')").select(F.col("id").alias("dst"), F.col("qualified_name").alias("target_qualified"))
    c = e.where("kind = 'CALLS'").select("source_qualified", "target_qualified").distinct()
    return c.join(s, "source_qualified").join(t, "target_qualified").select("src", "dst").distinct()


def _number(entries: DataFrame) -> DataFrame:
    """(entry, block, bit): entries in blocks of BLOCK_BITS, those of one folder next to each other, so that the flows of a block share most nodes. A range of the sorted entries begins its own block."""
    once = materialise(entries.select(F.col("id").alias("entry"), "file_path").distinct(), "entries")  # ranges are sampled from it
    ranged = once.repartitionByRange("file_path", "entry").sortWithinPartitions("file_path", "entry")
    at = ranged.withColumn("at", F.monotonically_increasing_id())  # the range in the upper 31 bits, the row in the lower 33
    return materialise(at.selectExpr("entry", f"shiftright(at, {BLOCK_BITS.bit_length() - 1}) AS block", f"cast(at & {BLOCK_BITS - 1} AS int) AS bit"), "numbers")


def _words(form: str) -> list[str]:
    """An expression for each word of a bit set."""
    return [form.format(i=i) for i in range(WORDS)]


def flow_bits(n: DataFrame, e: DataFrame, entries: DataFrame, depth: int = FLOW_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(numbers, reach): numbers(entry, block, bit), and reach(block, node, depth, n0..): bit sets of the entries of a block that reach
    the node over calls first at this depth.

    Up to BROADCAST_CALLS pairs of caller and callee are sent to the tasks, which walk a block each; beyond that all flows take a
    hop together, as joins. Both give the same rows."""
    calls = materialise(call_ids(n, e), "calls")
    numbers = _number(entries)
    return numbers, (_walk_blocks if calls.count() <= BROADCAST_CALLS else _walk_joins)(calls, numbers, depth)


def _walk_joins(calls: DataFrame, numbers: DataFrame, depth: int) -> DataFrame:
    """The state is a row per node and block of entries, not per pair; a hop is one join of the rows that changed and one
    aggregation by bit_or, which combines before the shuffle, so that a hub is no heavy key."""
    own = _words("bit_or(CASE WHEN bit div 64 = {i} THEN shiftleft(1L, cast(bit % 64 AS int)) ELSE 0L END) AS w{i}")
    start = numbers.groupBy("block", F.col("entry").alias("node")).agg(*map(F.expr, own))
    levels = [materialise(start.selectExpr("block", "node", *_words("w{i}"), *_words("w{i} AS n{i}")), "flow")]
    for _ in range(depth):
        seen = levels[-1]
        front = seen.where(_ANY).selectExpr("block", "node AS src", *_words("n{i}"))
        hop = front.join(calls, "src").groupBy("block", F.col("dst").alias("node")).agg(*map(F.expr, _words("bit_or(n{i}) AS h{i}")))
        both = seen.select("block", "node", *_words("w{i}")).join(hop, ["block", "node"], "full")
        step = both.selectExpr("block", "node", *_words("coalesce(w{i}, 0L) | coalesce(h{i}, 0L) AS w{i}"), *_words("coalesce(h{i}, 0L) & ~coalesce(w{i}, 0L) AS n{i}"))
        fresh = Observation()  # counted while the level is written
        nxt = materialise(step.observe(fresh, F.count(F.when(F.expr(_ANY), 1)).alias("rows")), "flow")
        if not fresh.get["rows"]:
            break
        levels.append(nxt)
    return _stack([x.where(_ANY).select("block", "node", F.lit(k).alias("depth"), *_words("n{i}")) for k, x in enumerate(levels)])


def _walk_blocks(calls: DataFrame, numbers: DataFrame, depth: int) -> DataFrame:
    """One task per block walks its entries over the calls, which are shared as sorted arrays: a hop is a gather and an OR per callee."""
    pairs = calls.toPandas()  # at most BROADCAST_CALLS
    ids = np.unique(np.concatenate([pairs["src"].to_numpy(np.int64), pairs["dst"].to_numpy(np.int64)]))
    order = np.argsort(pairs["dst"].to_numpy(), kind="stable")
    shared = calls.sparkSession.sparkContext.broadcast((ids, np.searchsorted(ids, pairs["src"].to_numpy()[order]).astype(np.int32), np.searchsorted(ids, pairs["dst"].to_numpy()[order]).astype(np.int32)))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        known, src, dst = shared.value
        nodes = np.union1d(known, g["entry"].to_numpy(np.int64)) if len(np.setdiff1d(g["entry"], known)) else known
        if nodes is not known:
            at = np.searchsorted(nodes, known).astype(np.int32)
            src, dst = at[src], at[dst]
        seen = np.zeros((len(nodes), WORDS), np.uint64)
        bit = g["bit"].to_numpy(np.int64)
        np.bitwise_or.at(seen, (np.searchsorted(nodes, g["entry"].to_numpy(np.int64)), bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        front, out = seen.copy(), []
        for k in range(depth + 1):
            rows = np.flatnonzero(front.any(axis=1))
            if not len(rows):
                break
            out.append((nodes[rows], np.full(len(rows), k, np.int32), front[rows].view(np.int64)))
            if k == depth:
                break
            live = np.zeros(len(nodes), bool)
            live[rows] = True
            use = np.flatnonzero(live[src])
            hop = np.zeros_like(front)
            if len(use):
                d = dst[use]
                first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
                hop[d[first]] = np.bitwise_or.reduceat(front[src[use]], first, axis=0)
            front = hop & ~seen
            seen |= front
        bits = np.concatenate([x[2] for x in out])
        return pd.DataFrame({"block": g["block"].iloc[0], "node": np.concatenate([x[0] for x in out]), "depth": np.concatenate([x[1] for x in out]), **{f"n{i}": bits[:, i] for i in range(WORDS)}})

    return materialise(numbers.groupBy("block").applyInPandas(walk, "block bigint, node bigint, depth int, " + ", ".join(_words("n{i} bigint"))), "flow")  # BLOCK_BITS rows a group


def _explode(bits: DataFrame, numbers: DataFrame, *more: str) -> DataFrame:
    """One row per set bit of n0..: (entry, node, more)."""
    w = bits.select("block", "node", *more, F.posexplode(F.array(*_words("n{i}"))).alias("word", "value")).where("value <> 0")
    b = w.select("block", "node", *more, "word", F.expr("explode(filter(sequence(0, 63), k -> value & shiftleft(1L, k) <> 0L))").alias("k"))
    return b.withColumn("bit", F.expr("cast(word * 64 + k AS int)")).join(numbers, ["block", "bit"]).select("entry", "node", *more)


def trace_flows(n: DataFrame, e: DataFrame, entries: DataFrame, depth: int = FLOW_DEPTH) -> DataFrame:
    """(entry, node, depth): everything each entry point reaches over calls, at its least depth; flows of one node are dropped.

    The result is a row per pair; the trace itself keeps bit sets (flow_bits)."""
    numbers, reach = flow_bits(n, e, entries, depth)
    more = reach.where("depth > 0").groupBy("block").agg(*map(F.expr, _words("bit_or(n{i}) AS m{i}")))  # entries of more than one node
    return _explode(reach.join(more, "block").selectExpr("block", "node", "depth", *_words("n{i} & m{i} AS n{i}")), numbers, "depth")


def _stack(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def _bit_sums(rows: DataFrame, facts: list[str]) -> DataFrame:
    """(block, bit, facts): sums of the facts of the rows whose set w0.. holds each bit, as one product per batch and block."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, g in b.groupby("block", sort=False):
                words = np.ascontiguousarray(g[_words("w{i}")].to_numpy(np.int64)).view(np.uint8)
                x = np.unpackbits(words, axis=1, bitorder="little").astype(np.float64)
                total = g[facts].to_numpy(np.float64).T @ x
                at = np.flatnonzero(x.any(axis=0))
                yield pd.DataFrame({"block": block, "bit": at.astype(np.int32), **{f: total[i, at].astype(np.int64) for i, f in enumerate(facts)}})

    part = rows.sortWithinPartitions("block").mapInPandas(add, "block bigint, bit int, " + ", ".join(f"{f} bigint" for f in facts))
    return part.groupBy("block", "bit").agg(*[F.sum(f).alias(f) for f in facts])


def criticality(n: DataFrame, e: DataFrame, entries: DataFrame, depth: int = FLOW_DEPTH) -> DataFrame:
    """(entry, nodes, files, depth, criticality) of the flow of each entry point: spread over files .30, calls outside .20, security .25, missing tests .15, depth .10; flows of one node are dropped.

    Sums are taken over bit sets: pairs of entry and node are never written out."""
    numbers, reach = flow_bits(n, e, entries, depth)
    known = n.select(F.col("qualified_name").alias("target_qualified"))
    outside = e.where("kind = 'CALLS' and target_qualified is not null").join(known, "target_qualified", "left_anti").groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("outside"))
    tested = e.where("kind = 'TESTED_BY' and source_qualified is not null").select(F.col("source_qualified").alias("qualified_name"), F.lit(1).alias("tested")).distinct()
    facts = n.select(F.col("id").alias("node"), "qualified_name", "file_path", rules.security(F.col("name"), F.col("qualified_name")).cast("int").alias("s"))
    facts = facts.join(outside, "qualified_name", "left").join(tested, "qualified_name", "left").select("node", F.xxhash64("file_path").alias("file"), "s", F.coalesce("outside", F.lit(0)).alias("o"), F.coalesce("tested", F.lit(0)).alias("t"))
    seen = reach.groupBy("block", "node").agg(*map(F.expr, _words("bit_or(n{i}) AS w{i}")))
    j = materialise(seen.join(facts, "node").withColumn("nodes", F.lit(1)), "facts")
    sums = _bit_sums(j.drop("node", "file"), ["nodes", "o", "s", "t"])
    files = _bit_sums(j.groupBy("block", "file").agg(*map(F.expr, _words("bit_or(w{i}) AS w{i}"))).withColumn("files", F.lit(1)), ["files"])
    deep = reach.groupBy("block", F.col("depth").alias("node")).agg(*map(F.expr, _words("bit_or(n{i}) AS n{i}")))
    deepest = _explode(deep, numbers).groupBy("entry").agg(F.max("node").alias("depth")).where("depth > 0")  # at most `depth` rows an entry
    g = numbers.join(sums, ["block", "bit"]).join(files, ["block", "bit"]).join(deepest, "entry")
    one = F.lit(1.0)
    score = F.lit(0.30) * F.least((F.col("files") - 1) / F.lit(4.0), one) + F.lit(0.20) * F.least(F.col("o") / F.lit(5.0), one) + F.lit(0.25) * (F.col("s") / F.col("nodes")) + F.lit(0.15) * (1 - F.col("t") / F.col("nodes")) + F.lit(0.10) * F.least(F.col("depth") / F.lit(10.0), one)
    return g.select("entry", "nodes", "files", "depth", F.round(F.least(F.greatest(score, F.lit(0.0)), one), 4).alias("criticality"))


def file_links(n: DataFrame, e: DataFrame) -> DataFrame:
    """(file, dependent): files with an edge into another file."""
    d = e.where("coalesce(kind, '') <> 'CONTAINS' and target_qualified is not null").select(path_of(F.col("target_qualified")).alias("file"), F.col("file_path").alias("dependent")).where("file <> dependent").distinct()
    return d.join(n.where("kind = 'File'").select(F.col("file_path").alias("file")).distinct(), "file", "left_semi")


def dependents(n: DataFrame, e: DataFrame, hops: int = 2) -> DataFrame:
    """(file, dependent, hops): files that depend on each file, over at most two hops, at the fewest."""
    one = materialise(file_links(n, e), "links")
    out = one.withColumn("hops", F.lit(1))
    level = one
    for k in range(2, hops + 1):
        level = level.join(one.select(F.col("file").alias("dependent"), F.col("dependent").alias("next")), "dependent").select("file", F.col("next").alias("dependent")).where("file <> dependent").distinct()
        out = out.unionByName(level.withColumn("hops", F.lit(k)))
    return out.groupBy("file", "dependent").agg(F.min("hops").alias("hops"))


def flows_by_name(flows: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, flow_id, name): the first flow, by id, whose name holds each asked string, in any case. At most 1,000 strings."""
    few = asked.where("asked is not null").distinct()
    if few.limit(1001).count() > 1000:
        raise ValueError("ask for at most 1,000 names at once")
    hit = flows.join(F.broadcast(few), F.contains(F.lower("name"), F.lower("asked")))
    return hit.groupBy("asked").agg(F.min(F.struct("id", "name")).alias("f")).select("asked", F.col("f.id").alias("flow_id"), "f.name")


def flow_steps(flows: DataFrame, n: DataFrame) -> DataFrame:
    """(flow_id, position, node_id, qualified_name): steps of stored flows in order; ids without a node keep a null name."""
    ids = F.from_json("path_json", "array<bigint>")
    steps = flows.select(F.col("id").alias("flow_id"), F.posexplode(ids).alias("position", "node_id"))
    return steps.join(n.select(F.col("id").alias("node_id"), "qualified_name"), "node_id", "left").select("flow_id", "position", "node_id", "qualified_name")


def flow_snapshots(flows: DataFrame) -> DataFrame:
    """(flow_id, entry, middle, last): the ends of a stored flow and up to three steps between."""
    p = F.from_json("path_json", "array<bigint>")
    return flows.select(F.col("id").alias("flow_id"), p[0].alias("entry"), F.when(F.size(p) > 2, F.slice(p, 2, F.least(F.lit(3), F.greatest(F.size(p) - 2, F.lit(1))))).otherwise(F.array().cast("array<bigint>")).alias("middle"), F.element_at(p, -1).alias("last")).where("entry is not null")


def affected_flows(memberships: DataFrame, flows: DataFrame, n: DataFrame, changed_files: DataFrame) -> DataFrame:
    """(flow_id, name, criticality, hits): stored flows through symbols of the changed files."""
    ids = n.join(changed_files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("node_id"))
    m = memberships.where("node_id is not null").select("flow_id", "node_id").distinct().join(ids, "node_id", "left_semi").groupBy("flow_id").agg(F.count(F.lit(1)).alias("hits"))
    return m.join(flows.select(F.col("id").alias("flow_id"), "name", "criticality"), "flow_id").select("flow_id", "name", "criticality", "hits")


def referrer_files(e: DataFrame, gone: DataFrame) -> DataFrame:
    """Files with an edge from or to a deleted name (qualified_name), the files of deleted names aside."""
    names = gone.where("qualified_name is not null").select("qualified_name").distinct()
    touch = e.select("file_path", F.explode(F.array("source_qualified", "target_qualified")).alias("qualified_name"))
    hit = touch.join(names, "qualified_name", "left_semi").select("file_path").distinct()
    return hit.join(names.select(path_of(F.col("qualified_name")).alias("file_path")).distinct(), "file_path", "left_anti")


def neighbour_files(e: DataFrame) -> DataFrame:
    """(file, neighbour): files one call or import apart."""
    p = e.where("kind in ('CALLS', 'IMPORTS_FROM') and source_qualified is not null and target_qualified like '/%'").select(path_of(F.col("source_qualified")).alias("a"), path_of(F.col("target_qualified")).alias("b")).where("a <> b")
    return p.select(F.col("a").alias("file"), F.col("b").alias("neighbour")).unionByName(p.select(F.col("b").alias("file"), F.col("a").alias("neighbour"))).distinct()


def recent_files(n: DataFrame, days: int = 180) -> DataFrame:
    """Files changed within the last days of the graph."""
    last = n.agg(F.max("updated_at").alias("last"))
    return n.where("kind = 'File'").join(F.broadcast(last)).where(F.col("updated_at") >= F.col("last") - F.expr(f"interval {days} days")).select("file_path").distinct()  # a single row


def is_real(c: str) -> Column:
    """Whether a name is a path rather than a bare name."""
    return F.col(c).contains("/")
