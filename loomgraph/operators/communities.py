"""Communities of the graph: by directory, by modularity, and what is reported about them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.session import materialise

ROUNDS, LEVELS = 10, 3
#: A level is at rest when no more than this share of its nodes would move.
STILL = 0.01
# Words too common to name a community.
COMMON_WORDS = "get set self init new create update delete add remove make build from to for with the and test main run do is has on of in at by my this that all none should when then given return returns raise raises expect expected assert tests be it if not".split()


def dirs(path: Column) -> Column:
    """The directories of a path."""
    return F.filter(F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1), lambda p: p != "")


def by_directory(n: DataFrame, min_size: int = 2, wanted: int = 10) -> DataFrame:
    """(qualified_name, community): symbols by directory below the common prefix, at the least depth that gives `wanted` groups of min_size."""
    s = n.where("kind <> 'File'").select("qualified_name", "file_path", dirs(F.col("file_path")).alias("d"))
    per_dir = s.groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    ends = per_dir.agg(F.min("d").alias("a"), F.max("d").alias("b"), F.max(F.size("d")).alias("deep")).first()
    if ends.a is None:
        return s.select("qualified_name", F.lit("").alias("community"))
    prefix = next((i for i, (x, y) in enumerate(zip(ends.a, ends.b)) if x != y), min(len(ends.a), len(ends.b)))  # of the least and greatest, so of all
    key = lambda depth: F.array_join(F.slice("d", prefix + 1, depth), "/")
    depth = 1
    for depth in range(1, max(2, ends.deep - prefix + 1)):
        if per_dir.groupBy(key(depth).alias("k")).agg(F.sum("n").alias("n")).where(F.col("n") >= min_size).count() >= wanted:
            break
    stem = F.regexp_replace(F.substring_index("file_path", "/", -1), r"\.[^.]*$", "")
    out = s.select("qualified_name", F.when(F.size("d") > prefix, key(depth)).otherwise(stem).alias("community"))
    big = out.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size).select("community")
    return out.join(big, "community", "left_semi").select("qualified_name", "community")


def cohesion(members: DataFrame, e: DataFrame) -> DataFrame:
    """(community, size, internal, external, cohesion): share of the edges at a community that stay in it; one pass over the edges."""
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    a = members.select(F.col("qualified_name").alias("source_qualified"), F.col("community").alias("ca"))
    b = members.select(F.col("qualified_name").alias("target_qualified"), F.col("community").alias("cb"))
    by_source = e.join(a, "source_qualified", "left").groupBy("ca", "target_qualified").agg(F.count(F.lit(1)).alias("n"))  # a hot target is a row per community from here
    j = by_source.join(b, "target_qualified", "left").groupBy("ca", "cb").agg(F.sum("n").alias("n"))
    inside = j.where("ca = cb").select(F.col("ca").alias("community"), F.col("n").alias("i"), F.lit(0).alias("x"))
    outside = j.where("ca is distinct from cb").select(F.explode(F.array_compact(F.array("ca", "cb"))).alias("community"), F.lit(0).alias("i"), F.col("n").alias("x"))
    g = inside.unionByName(outside).groupBy("community").agg(F.sum("i").alias("internal"), F.sum("x").alias("external"))
    i, x = F.coalesce("internal", F.lit(0)), F.coalesce("external", F.lit(0))
    return size.join(g, "community", "left").select("community", "size", i.alias("internal"), x.alias("external"), F.when(i + x > 0, F.round(i / (i + x), 4)).otherwise(0.0).alias("cohesion"))


def reassign_tests(members: DataFrame, n: DataFrame, e: DataFrame) -> DataFrame:
    """Members with each test in the community most of its subjects are in; a tie keeps the current one, then the first by name."""
    tests = n.where("is_test or kind = 'Test'").select("qualified_name")
    votes = e.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("subject"), F.col("target_qualified").alias("qualified_name")).distinct()
    votes = votes.join(tests, "qualified_name", "left_semi").join(members.select(F.col("qualified_name").alias("subject"), F.col("community").alias("vote")), "subject")
    counted = votes.groupBy("qualified_name", "vote").agg(F.count(F.lit(1)).alias("votes"))
    best = counted.join(members, "qualified_name", "left").groupBy("qualified_name").agg(F.min(F.struct((-F.col("votes")).alias("v"), (F.coalesce(F.col("vote") != F.col("community"), F.lit(True))).alias("moved"), "vote")).alias("b"))
    return members.join(best, "qualified_name", "left").select("qualified_name", F.coalesce("b.vote", "community").alias("community"))


def pair_edges(members: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, kind, n): edges between two communities, tests aside, per unordered pair and kind."""
    m1 = members.select(F.col("qualified_name").alias("source_qualified"), F.col("community").alias("ca"))
    m2 = members.select(F.col("qualified_name").alias("target_qualified"), F.col("community").alias("cb"))
    by_source = e.where("coalesce(kind, '') <> 'TESTED_BY'").join(m1, "source_qualified").groupBy("ca", "target_qualified", "kind").agg(F.count(F.lit(1)).alias("n"))  # a hot target is a row per community and kind from here
    x = by_source.join(m2, "target_qualified").where("ca <> cb")
    return x.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "kind").agg(F.sum("n").alias("n"))


def test_named(name: Column) -> Column:
    """Whether a community is of tests, by its name."""
    return name.rlike(r"(?i)(^test[-/]|[-/]test([:/]|$)|it:should|describe:|spec[-/]|[-/]spec$)")


def overview(members: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, edges, top_kinds, warning): coupling of communities; a warning above ten edges unless one side is of tests."""
    p = pair_edges(members, e)
    w = Window.partitionBy("a", "b").orderBy(F.desc("n"), "kind")  # one row per edge kind
    top = p.withColumn("k", F.row_number().over(w))
    g = top.groupBy("a", "b").agg(F.sum("n").alias("edges"), F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "kind")))).alias("t"))
    return g.select("a", "b", "edges", F.transform("t", lambda s: F.coalesce(s["kind"], F.lit("-"))).alias("top_kinds"), ((F.col("edges") > 10) & ~test_named(F.col("a")) & ~test_named(F.col("b"))).alias("warning"))


def top_folders(members: DataFrame, n: DataFrame, depth: int = 2, k: int = 2) -> DataFrame:
    """(community, folder, share, place): the k folders, cut at a depth, that hold most members of each community."""
    f = members.join(n.select("qualified_name", "file_path"), "qualified_name")
    counts = f.groupBy("community", F.array_join(F.slice(dirs(F.col("file_path")), 1, depth), "/").alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("community").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), "folder")  # a row per folder
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).join(total, "community").select("community", "folder", F.round(F.col("n") / F.col("total"), 4).alias("share"), "place")


def names(members: DataFrame, n: DataFrame) -> DataFrame:
    """(community, name): its commonest directory, with a class that holds more than 40 % of it, else its commonest word; equal names get numbers, the largest first."""
    f = members.join(n.select("qualified_name", "file_path", "kind", "name"), "qualified_name")
    size = f.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    folder = F.coalesce(F.element_at(dirs(F.col("file_path")), -1), F.lit("root"))
    most = lambda df, c: df.groupBy("community", c).agg(F.count(F.lit(1)).alias("k")).groupBy("community").agg(F.min(F.struct((-F.col("k")).alias("k"), F.col(c).alias("v"))).alias("b"))
    d = most(f.select("community", folder.alias("x")), "x").select("community", F.col("b.v").alias("dir"))
    c = most(f.where("kind = 'Class'").select("community", "name"), "name").select("community", F.col("b.v").alias("cls"), (-F.col("b.k")).alias("cls_n"))
    words = f.where("kind in ('Function', 'Class', 'Test', 'Type')").select("community", F.explode(rules.split_words(F.col("name"))).alias("w")).select("community", F.lower("w").alias("w")).where(~F.col("w").isin(COMMON_WORDS) & (F.length("w") > 1))
    k = most(words, "w").select("community", F.col("b.v").alias("word"))
    j = size.join(d, "community", "left").join(c, "community", "left").join(k, "community", "left")
    slug = lambda x: F.lower(F.array_join(rules.split_words(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")), "-"))
    base = F.concat_ws("-", slug(F.col("dir")), slug(F.when(F.col("cls_n") > 0.4 * F.col("size"), F.col("cls")).otherwise(F.col("word"))))
    named = j.select("community", "size", F.substring(base, 1, 60).alias("name"))
    w = Window.partitionBy("name").orderBy(F.desc("size"), "community")  # communities of one name
    return named.withColumn("k", F.row_number().over(w)).select("community", F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat_ws("-", "name", "k")).alias("name"), "size")


def modularity_graph(n: DataFrame, e: DataFrame) -> DataFrame:
    """(a, b, w): undirected weighted edges between symbols, by id, a < b; of several edges of a pair the first in order counts."""
    ids = n.where("kind <> 'File'").select("id", "qualified_name")
    s, t = ids.select(F.col("id").alias("i"), F.col("qualified_name").alias("source_qualified")), ids.select(F.col("id").alias("j"), F.col("qualified_name").alias("target_qualified"))
    p = e.join(s, "source_qualified").join(t, "target_qualified").where("i <> j").withColumn("w", rules.weight(F.col("kind"), rules.COMMUNITY_WEIGHTS))
    first = F.min_by("w", F.struct("source_qualified", "target_qualified", F.coalesce("kind", F.lit("")), "file_path", "line", F.col("id")))
    return p.groupBy(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).agg(first.alias("w"))


def modularity(graph: DataFrame, rounds: int = ROUNDS, levels: int = LEVELS, resolution: float | None = None) -> DataFrame:
    """(id, community): local moving until hardly a node (STILL) would move, at most `rounds` rounds, communities contracted to nodes of the next level, for at most `levels` levels; communities that are not connected are split at last. A community is named by its least id."""
    both = materialise(graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")), "edges")
    deg = materialise(both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k")), "degrees")
    total = deg.agg(F.sum("k").alias("m"), F.count(F.lit(1)).alias("n")).first()
    if not total.m:
        return deg.select("id", F.col("id").alias("community"))
    gamma = resolution if resolution is not None else max(0.05, 1 / math.log10(max(total.n, 10)))
    edges, nodes, place = both, deg, None
    for _ in range(levels):
        moved, comm = _local_moving(edges, nodes, gamma, total.m, rounds)
        place = comm.select("id", "community") if place is None else materialise(place.join(comm.select(F.col("id").alias("community"), F.col("community").alias("upper")), "community").select("id", F.col("upper").alias("community")), "place")
        if not moved:
            break
        c = lambda x: comm.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))  # noqa: B023,E731
        edges = materialise(edges.join(c("a"), "a").join(c("b"), "b").where("ca <> cb").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "edges")
        nodes = materialise(comm.groupBy(F.col("community").alias("id")).agg(F.sum("k").alias("k")), "degrees")
    return connected_parts(both, place)


def _local_moving(both: DataFrame, nodes: DataFrame, gamma: float, m: float, rounds: int) -> tuple[int, DataFrame]:
    """(moves, (id, community, k)): synchronous moves. In each round a half of the nodes, by hash, moves to the neighbouring community of the greatest gain, ties to the least id.

    Work per round is one join and two aggregations over the edges; a hub's edges are summed per community before they meet. The
    totals of communities are joined to one row per node and neighbouring community."""
    comm, moves = nodes.select("id", F.col("id").alias("community"), "k"), 0
    for r in range(rounds):
        tot = comm.groupBy("community").agg(F.sum("k").alias("tot"))
        near = both.join(comm.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("w").alias("inside"))
        mine = comm.withColumnRenamed("community", "own")
        cand = near.join(mine, "id").join(tot, "community")
        minus = F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("inside") - gamma * F.col("k") * (F.col("tot") - minus) / m, 9)
        best = cand.withColumn("gain", gain).groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), (F.col("community") != F.col("own")).alias("moved"), "community")).alias("b"))
        turn = F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0
        step = comm.join(best, "id", "left").select("id", F.when(turn & (F.col("b.g") < 0), F.col("b.community")).otherwise(F.col("community")).alias("community"), "k", (F.coalesce(F.col("b.g") < 0, F.lit(False)) & F.coalesce("b.moved", F.lit(False))).alias("wants"))
        seen = Observation()
        comm = materialise(step.observe(seen, F.count(F.when(F.col("wants"), 1)).alias("wants"), F.count(F.lit(1)).alias("nodes")), "communities").drop("wants")
        wants = seen.get["wants"]
        moves += wants
        if wants <= STILL * seen.get["nodes"]:
            break
    return moves, comm


def connected_parts(both: DataFrame, comm: DataFrame) -> DataFrame:
    """(id, community): each connected part of a community under its least id: the least label spreads over edges and along labels, so that the number of rounds grows with the logarithm of a part's width."""
    c = lambda x: comm.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    inside = materialise(both.select("a", "b").join(c("a"), "a").join(c("b"), "b").where("ca = cb").select("a", "b"), "inside")
    label = comm.select("id", F.col("id").alias("label"))
    while True:
        least = inside.join(label.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        hop = materialise(label.join(least, "id", "left").select("id", "label", F.least("label", "near").alias("new")), "hop")
        jump = hop.join(hop.select(F.col("id").alias("new"), F.col("new").alias("further")), "new")
        seen = Observation()
        step = jump.select("id", F.least("new", "further").alias("next"), "label")
        done = materialise(step.observe(seen, F.count(F.when(F.col("next") != F.col("label"), 1)).alias("moved")), "labels")
        label = done.select("id", F.col("next").alias("label"))
        if not seen.get["moved"]:
            return label.select("id", F.col("label").alias("community"))


def split_oversized(graph: DataFrame, comm: DataFrame, share: float = 0.25, least: int = 10, resolution: float = 0.5) -> DataFrame:
    """(id, community): communities of more than `share` of all members (and more than `least`) are divided by modularity within themselves; a community that does not fall apart stays."""
    sizes = materialise(comm.groupBy("community").agg(F.count(F.lit(1)).alias("size")), "sizes")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    big = sizes.where(F.col("size") > max(int(total * share), least)).select("community")  # at most 1 / share rows
    if big.limit(1).count() == 0:
        return comm
    inside = comm.join(F.broadcast(big), "community")
    c = lambda x: inside.select(F.col("id").alias(x), F.col("community").alias(f"c{x}"))
    part = modularity(graph.join(c("a"), "a").join(c("b"), "b").where("ca = cb").select("a", "b", "w"), resolution=resolution)
    return comm.join(part.withColumnRenamed("community", "part"), "id", "left").select("id", F.coalesce("part", "community").alias("community"))


def modularity_score(graph: DataFrame, comm: DataFrame) -> DataFrame:
    """(q): modularity of an assignment at resolution 1."""
    both = graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    j = both.join(comm.select(F.col("id").alias("a"), F.col("community").alias("x")), "a").join(comm.select(F.col("id").alias("b"), F.col("community").alias("y")), "b")
    per = j.groupBy("x").agg(F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("i"), F.sum("w").alias("t"))
    m = per.agg(F.sum("t").alias("m"))
    return per.join(F.broadcast(m)).agg(F.round(F.sum(F.col("i") / F.col("m") - (F.col("t") / F.col("m")) * (F.col("t") / F.col("m"))), 6).alias("q"))  # a single row


def top_symbols(members: DataFrame, degrees: DataFrame, k: int = 5) -> DataFrame:
    """(community, qualified_name, degree, place): the k symbols of most edges of each community; within salts first."""
    j = members.join(degrees, "qualified_name", "left").select("community", "qualified_name", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("salt", F.pmod(F.xxhash64("qualified_name"), F.lit(32)))
    w1 = Window.partitionBy("community", "salt").orderBy(F.desc("degree"), "qualified_name")
    w2 = Window.partitionBy("community").orderBy(F.desc("degree"), "qualified_name")  # at most 32 k rows
    return j.withColumn("r", F.row_number().over(w1)).where(F.col("r") <= k).withColumn("place", F.row_number().over(w2)).where(F.col("place") <= k).select("community", "qualified_name", "degree", "place")
