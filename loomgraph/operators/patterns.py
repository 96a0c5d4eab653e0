"""The named questions to the graph, answered for all targets at once; filter on `target` for one.

Each takes the canonical nodes and edges (or the part of them that a caller asks about) and returns one row per answer.
Lines of several calls of one pair are collected per pair, never per target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules


def _lines(e: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct call lines per pair and file, as an ordered list."""
    return e.groupBy(F.col(a).alias("target"), F.col(b).alias("answer")).agg(F.array_sort(F.collect_set("line")).alias("lines"), F.count(F.lit(1)).alias("calls"))


def callers_of(n: DataFrame, e: DataFrame) -> DataFrame:
    """(target, answer, lines, calls): callers of each resolved target, builtin names aside."""
    calls = e.where("kind = 'CALLS' and source_qualified is not null and target_qualified is not null").where(~F.col("target_qualified").isin(rules.BUILTIN_CALLS))
    known = n.select(F.col("qualified_name").alias("source_qualified"))
    return _lines(calls.join(known, "source_qualified", "left_semi"), "target_qualified", "source_qualified")


def callees_of(e: DataFrame) -> DataFrame:
    """(target, answer, lines, calls): what each function calls, targets without a node included."""
    return _lines(e.where("kind = 'CALLS' and source_qualified is not null and target_qualified is not null"), "source_qualified", "target_qualified")


def sources_of(n: DataFrame, e: DataFrame, kinds: list[str], known: bool = True) -> DataFrame:
    """(target, answer): distinct sources of edges of some kinds into each target."""
    out = e.where(F.col("kind").isin(kinds) & F.col("source_qualified").isNotNull() & F.col("target_qualified").isNotNull()).select(F.col("target_qualified").alias("target"), F.col("source_qualified").alias("answer")).distinct()
    return out.join(n.select(F.col("qualified_name").alias("answer")), "answer", "left_semi").select("target", "answer") if known else out


def targets_of(n: DataFrame, e: DataFrame, kinds: list[str], known: bool = True, node_kind: str | None = None) -> DataFrame:
    """(target, answer): distinct targets of edges of some kinds out of each node."""
    out = e.where(F.col("kind").isin(kinds) & F.col("source_qualified").isNotNull() & F.col("target_qualified").isNotNull()).select(F.col("source_qualified").alias("target"), F.col("target_qualified").alias("answer")).distinct()
    real = n.where(F.col("kind") == node_kind) if node_kind else n
    return out.join(real.select(F.col("qualified_name").alias("answer")), "answer", "left_semi").select("target", "answer") if known or node_kind else out


def inheritors_of(n: DataFrame, e: DataFrame) -> DataFrame:
    """(target, answer, bare): subtypes of each class; edges to a bare name count only for classes that have no others."""
    inh = e.where("kind in ('INHERITS', 'IMPLEMENTS') and source_qualified is not null and target_qualified is not null").select("target_qualified", "source_qualified").distinct()
    classes = n.where("kind in ('Class', 'Type')").select(F.col("qualified_name").alias("target"), "name")
    exact = classes.join(inh, F.col("target") == F.col("target_qualified")).select("target", F.col("source_qualified").alias("answer"), F.lit(False).alias("bare"))
    bare = classes.join(exact, "target", "left_anti").join(inh, F.col("name") == F.col("target_qualified")).select("target", F.col("source_qualified").alias("answer"), F.lit(True).alias("bare"))
    return exact.unionByName(bare)


def tests_for(n: DataFrame, e: DataFrame) -> DataFrame:
    """(target, answer, inferred): tests by edges, else by the convention test_<name> within the language."""
    direct = e.where("kind = 'TESTED_BY' and source_qualified is not null and target_qualified is not null").select(F.col("source_qualified").alias("target"), F.col("target_qualified").alias("answer")).distinct().withColumn("inferred", F.lit(False))
    funcs = n.where("kind = 'Function' and not is_test").select(F.col("qualified_name").alias("target"), F.concat(F.lit("test_"), F.col("name")).alias("test_name"), F.substring_index("file_path", "/", 4).alias("root"))
    tests = n.where("kind = 'Test' or is_test").select(F.col("qualified_name").alias("answer"), F.col("name").alias("test_name"), F.substring_index("file_path", "/", 4).alias("root"))
    named = funcs.join(tests, ["test_name", "root"]).select("target", "answer", F.lit(True).alias("inferred"))
    return direct.unionByName(named.join(direct, ["target", "answer"], "left_anti"))


def config_consumers(n: DataFrame, e: DataFrame) -> DataFrame:
    """(target, answer): symbols that depend on a configuration key: exactly, or by a wildcard of one of its ancestors."""
    key = F.regexp_replace(F.lower("name"), "[-_]", "")
    parts = F.split("key", r"\.")
    props = n.where("kind = 'ConfigProperty'").select(F.col("qualified_name").alias("target"), "name").withColumn("key", key)
    asked = props.select("target", F.explode(F.concat(F.array("name", "target"), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "."), F.lit(".*"))))).alias("target_qualified"))
    dep = e.where("kind in ('DEPENDS_ON_CONFIG', 'CONSUMES') and source_qualified is not null").select("target_qualified", F.col("source_qualified").alias("answer"))
    return asked.join(dep, "target_qualified").select("target", "answer").distinct()


def file_summary(n: DataFrame) -> DataFrame:
    """(target, answer, kind, line_start, line_end): the symbols of each file."""
    return n.where("kind <> 'File'").select(F.col("file_path").alias("target"), F.col("qualified_name").alias("answer"), "kind", "line_start", "line_end")


def calls_by_pair(e: DataFrame) -> DataFrame:
    """(source, target, lines, elsewhere, tier): call sites of a pair in the caller's file, how many are elsewhere, and the weakest confidence tier."""
    c = e.where("kind = 'CALLS' and source_qualified is not null and target_qualified is not null").withColumn("own", F.substring_index("source_qualified", "::", 1) == F.col("file_path"))
    tier = F.when(F.upper("confidence_tier") == "AMBIGUOUS", 0).when(F.upper("confidence_tier") == "INFERRED", 1).otherwise(2)
    g = c.groupBy("source_qualified", "target_qualified").agg(F.array_sort(F.collect_set(F.when(F.col("own"), F.col("line")))).alias("lines"), F.count(F.when(~F.coalesce("own", F.lit(False)), 1)).alias("elsewhere"), F.min(tier).alias("t"))
    return g.select("source_qualified", "target_qualified", "lines", "elsewhere", F.when(F.col("t") == 0, "AMBIGUOUS").when(F.col("t") == 1, "INFERRED").otherwise("EXTRACTED").alias("tier"))


def resolve_targets(n: DataFrame, asked: DataFrame, limit: int = 20) -> DataFrame:
    """asked(asked) with status and ranked candidates: the exact name, else the path, else names and parts of names.

    rank 0 exact qualified name, 1 exact name, 2 part of the qualified name's last segment; then by qualified name, `limit` of each."""
    q = n.select("qualified_name", "name", "file_path", "kind")
    exact = asked.join(q, F.col("asked") == F.col("qualified_name")).select("asked", "qualified_name", F.lit(0).alias("rank"))
    named = asked.join(q, F.col("asked") == F.col("name")).select("asked", "qualified_name", F.lit(1).alias("rank"))
    word = q.select("qualified_name", F.explode(F.array_distinct(rules.split_words(F.col("name")))).alias("asked"))
    parts = asked.join(word, "asked").select("asked", "qualified_name", F.lit(2).alias("rank"))
    every = exact.unionByName(named).unionByName(parts).groupBy("asked", "qualified_name").agg(F.min("rank").alias("rank"))
    best = every.groupBy("asked").agg(F.min("rank").alias("top"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("asked").orderBy("rank", "qualified_name")
    ranked = every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)
    status = F.when(F.col("top") == 0, "ok").when(F.col("n") == 1, "ok").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    out = asked.join(best, "asked", "left").withColumn("status", status).join(ranked, "asked", "left")
    return out.where("status <> 'ok' or rank = top").select("asked", "status", "qualified_name", "rank", "place")


def bounded(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    """The first `limit` rows in an order, with the number of all rows: one count beside one top-k, no global window."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).limit(limit).join(F.broadcast(total))  # a single row
