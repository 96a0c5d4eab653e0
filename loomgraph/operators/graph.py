"""The canonical graph, lookups, joins and statistics.

Duplicates, re-parses and late rows are resolved first: the latest row of a qualified name is the node, an edge id is one
edge, endpoints are read with slashes. Edges may point to names without a node; they are kept, with their endpoints as names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.names import path_of, posix_name


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """One row per qualified name, its latest arrival (an upsert by name). Null names are no nodes."""
    rest = [c for c in nodes.columns if c != "qualified_name"]
    newest = F.max_by(F.struct(*rest), F.struct("ingested_at", "updated_at", "id"))
    return nodes.where("qualified_name is not null").groupBy("qualified_name").agg(newest.alias("n")).select("qualified_name", *[F.col(f"n.{c}").alias(c) for c in rest])


def unique_edges(edges: DataFrame) -> DataFrame:
    """One row per edge id, endpoints with slashes; rows without an id are told apart by all their values."""
    e = edges.drop("ingested_at")
    e = e.where("id is not null").dropDuplicates(["id"]).unionByName(e.where("id is null").distinct())
    return e.withColumns({"source_qualified": posix_name(F.col("source_qualified")), "target_qualified": posix_name(F.col("target_qualified"))})


def upsert_edges(edges: DataFrame) -> DataFrame:
    """One row per (kind, source, target, file, line, receiver), the latest update (an upsert by that key)."""
    key = ["kind", "source_qualified", "target_qualified", "file_path", "line", "receiver"]
    e = unique_edges(edges).withColumn("receiver", receiver(F.col("extra")))
    rest = [c for c in e.columns if c not in key]
    return e.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def receiver(extra: Column) -> Column:
    """The receiver a call was made on, if known; broken JSON has none."""
    return F.get_json_object(extra, "$.receiver")


def all_files(n: DataFrame, e: DataFrame) -> DataFrame:
    """Paths named by nodes or edges."""
    return n.select("file_path").union(e.select("file_path")).where("file_path is not null").distinct()


def file_test_flags(n: DataFrame) -> DataFrame:
    """(file_path, is_test) as the File rows say."""
    return n.where("kind = 'File'").select("file_path", "is_test")


def nodes_by_kind(n: DataFrame, kinds: list[str], part: str | None = None) -> DataFrame:
    """Nodes of some kinds whose path holds a string."""
    out = n.where(F.col("kind").isin(kinds))
    return out.where(F.col("file_path").contains(part)) if part else out


def nodes_by_size(n: DataFrame, least: int = 50, most: int | None = None, limit: int = 50) -> DataFrame:
    """The longest nodes of at least `least` lines (a top-k report)."""
    lines = F.col("line_end") - F.col("line_start") + 1
    out = n.where("line_start is not null and line_end is not null").withColumn("lines", lines).where(F.col("lines") >= least)
    out = out.where(F.col("lines") <= most) if most is not None else out
    return out.orderBy(F.desc("lines"), "qualified_name").limit(limit)


def semi(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is among `keys`; any number of keys."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def nodes_by_name(n: DataFrame, asked: DataFrame) -> DataFrame:
    """asked(asked) with the node of that name: the exact one, else the one of the name read with slashes. Any number of names."""
    a = asked.where("asked is not null").select("asked").distinct().withColumn("posix", posix_name(F.col("asked")))
    exact = a.join(n, F.col("asked") == F.col("qualified_name"))
    again = a.join(exact.select("asked"), "asked", "left_anti").join(n, F.col("posix") == F.col("qualified_name"))
    return exact.unionByName(again.select(*exact.columns)).drop("posix")


def edges_at(e: DataFrame, asked: DataFrame, side: str) -> DataFrame:
    """Edges out of (side source_qualified) or into (target_qualified) the names asked(qualified_name)."""
    return e.join(asked.where("qualified_name is not null").select(F.col("qualified_name").alias(side)).distinct(), side, "left_semi")


def community_of(members: DataFrame, asked: DataFrame) -> DataFrame:
    """(qualified_name, community) of the names asked(qualified_name); null for a name in none."""
    return asked.where("qualified_name is not null").select("qualified_name").distinct().join(members, "qualified_name", "left").select("qualified_name", "community")


def edges_with_source(e: DataFrame, n: DataFrame, kind: str = "CALLS") -> DataFrame:
    """Edges of a kind with the kind, name, file and language of the node they come from."""
    src = n.select(F.col("qualified_name").alias("source_qualified"), F.col("kind").alias("source_kind"), F.col("name").alias("source_name"), F.col("language").alias("source_language"))
    return e.where(F.col("kind") == kind).join(src, "source_qualified")


def bare_target_edges(e: DataFrame, n: DataFrame, kind: str = "CALLS") -> DataFrame:
    """Edges whose target is a bare name (no path), with the language family of their source."""
    return edges_with_source(e.where(~F.col("target_qualified").contains("::") & ~F.col("target_qualified").contains("/")), n, kind).withColumn("family", rules.language_family(F.col("source_language")))


def call_targets(e: DataFrame, n: DataFrame, from_files: bool = True) -> DataFrame:
    """Names that are called; from_files=False leaves out calls made at the top level of a file."""
    calls = e.where("kind = 'CALLS' and target_qualified is not null")
    if not from_files:
        files = n.where("kind = 'File'").select(F.col("qualified_name").alias("source_qualified"))
        calls = calls.join(files, "source_qualified", "left_anti")
    return calls.select(F.col("target_qualified").alias("qualified_name")).distinct()


def edges_among(e: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among `members` (qualified_name)."""
    m = members.select("qualified_name").distinct()
    return e.join(m.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_semi").join(m.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_semi")


def helper_tests(e: DataFrame, n: DataFrame) -> DataFrame:
    """(qualified_name, test): tests of a production function through a helper: tests that call something that is tested by them too, joined over the helper."""
    calls = e.where("kind = 'CALLS'").select(F.col("source_qualified").alias("helper"), F.col("target_qualified").alias("qualified_name"))
    tested = e.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("helper"), F.col("target_qualified").alias("test"))
    real = n.select(F.col("qualified_name").alias("test"), "kind").where("kind in ('Test', 'Function')").select("test")
    return calls.join(tested, "helper").join(real, "test", "left_semi").select("qualified_name", "test").distinct()


def range_overlap(n: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes that overlap a changed range: ranges(file_path, start, end). The path makes it a hash join; each node comes once."""
    r = ranges.select("file_path", F.col("start").alias("_s"), F.col("end").alias("_e"))
    hit = n.where("line_start is not null and line_end is not null").join(r, "file_path").where("line_start <= _e and line_end >= _s")
    return hit.dropDuplicates(["qualified_name"]).drop("_s", "_e")


def enclosing(points: DataFrame, n: DataFrame) -> DataFrame:
    """points(file_path, line, ...) with the innermost function whose lines hold the point; several points are answered at once."""
    f = n.where("kind in ('Function', 'Test')").select(F.col("file_path"), "qualified_name", "line_start", "line_end")
    j = points.join(f, "file_path").where("line between line_start and line_end")
    return j.groupBy("file_path", "line").agg(F.min_by("qualified_name", F.struct(F.col("line_end") - F.col("line_start"), F.col("qualified_name"))).alias("enclosing"))


def path_suffixes(path: Column) -> Column:
    """Every suffix of a path that begins at a segment, the whole path first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def suffix_join(names: DataFrame, files: DataFrame) -> DataFrame:
    """names(suffix) with the files whose path ends in it at a segment: suffixes are exploded, so that it is an equi-join."""
    s = files.select("file_path", F.explode(path_suffixes(F.col("file_path"))).alias("suffix"))
    return names.join(s, "suffix")


def partial_targets(e: DataFrame) -> DataFrame:
    """Call targets by the name after their last '::'."""
    return e.where("kind = 'CALLS' and target_qualified like '%::%'").select("source_qualified", "target_qualified", "file_path", "line", F.element_at(F.split("target_qualified", "::"), -1).alias("name"))


def degree(e: DataFrame) -> DataFrame:
    """(qualified_name, degree): edges in and out."""
    out = e.where("source_qualified is not null").groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n"))
    into = e.where("target_qualified is not null").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(into).groupBy("qualified_name").agg(F.sum("n").alias("degree"))


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """(what, key, n): totals, nodes by kind, edges by kind, files and languages."""
    def count(df: DataFrame, what: str, key: Column) -> DataFrame:
        return df.groupBy(key.cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "key", "n")

    one = F.lit("all")
    return (
        count(n, "nodes", one).unionByName(count(e, "edges", one)).unionByName(count(n, "node_kind", F.col("kind"))).unionByName(count(e, "edge_kind", F.col("kind")))
        .unionByName(count(n.where("kind = 'File'"), "files", one)).unionByName(count(n.where("language is not null").select("language").distinct(), "languages", one))
    )


def risk_index(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, qualified_name, risk_score, caller_count, test_coverage, security_relevant) of functions, classes and tests, by steps."""
    callers = e.where("kind = 'CALLS'").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("callers"))
    tests = e.where("kind = 'TESTED_BY'").groupBy(F.col("source_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("tests"))
    j = n.where("kind in ('Function', 'Class', 'Test')").select("id", "qualified_name", "name").join(callers, "qualified_name", "left").join(tests, "qualified_name", "left")
    c, tested = F.coalesce("callers", F.lit(0)), F.coalesce("tests", F.lit(0)) > 0
    sec = F.lower("name").rlike("|".join(rules.RISK_INDEX_WORDS))
    score = F.when(c > 10, 0.3).when(c > 3, 0.15).otherwise(0.0) + F.when(tested, 0.0).otherwise(0.3) + F.when(sec, 0.4).otherwise(0.0)
    return j.select("id", "qualified_name", F.round(F.least(score, F.lit(1.0)), 4).alias("risk_score"), c.alias("caller_count"), F.when(tested, "tested").otherwise("untested").alias("test_coverage"), sec.cast("int").alias("security_relevant"))


def top_dirs(files: DataFrame) -> DataFrame:
    """(top_dir, kind, files, share): files per directory below the checkout and kind, with the share of the directory."""
    parts = F.split(F.regexp_replace("file_path", "^/", ""), "/")
    d = files.select(F.when(F.size(parts) > 4, parts[3]).otherwise(F.lit(".")).alias("top_dir"), rules.file_kind(F.col("file_path")).alias("kind"))
    g = d.groupBy("top_dir", "kind").agg(F.count(F.lit(1)).alias("files"))
    w = Window.partitionBy("top_dir")  # at most four kinds
    return g.withColumn("share", F.round(F.col("files") / F.sum("files").over(w), 4))


def symbol_file(c: str) -> Column:
    """The file of a symbol column."""
    return path_of(F.col(c))
