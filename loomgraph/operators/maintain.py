"""Incremental maintenance: every change is old rows minus those it replaces, plus the new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise


def replace_files(old: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of some files replaced as a whole: their old rows go, whatever they were."""
    return old.join(files.select("file_path").distinct(), "file_path", "left_anti").unionByName(new.join(files.select("file_path").distinct(), "file_path", "left_semi"))


def changed_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path): files whose content hash is new or another one."""
    return new.select("file_path", "file_hash").distinct().join(old.select("file_path", "file_hash").distinct(), ["file_path", "file_hash"], "left_anti").select("file_path").distinct()


def stale_files(n: DataFrame, inventory: DataFrame) -> DataFrame:
    """(file_path): files in the graph that the inventory does not have."""
    return n.select("file_path").distinct().join(inventory.select("file_path").distinct(), "file_path", "left_anti")


def purge(n: DataFrame, e: DataFrame, vectors: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges of either side and vectors without those of some files."""
    f = files.select("file_path").distinct()
    gone = n.join(f, "file_path", "left_semi").select("qualified_name").distinct()
    edges = e.join(f, "file_path", "left_anti").join(gone.withColumnRenamed("qualified_name", "source_qualified"), "source_qualified", "left_anti").join(gone.withColumnRenamed("qualified_name", "target_qualified"), "target_qualified", "left_anti")
    return n.join(f, "file_path", "left_anti"), edges, vectors.join(gone, "qualified_name", "left_anti")


def path_marks(steps: DataFrame) -> DataFrame:
    """(entry, path): what tells the node sets of flows apart: their number, ends and two mixed hashes. steps(entry, node), each pair once."""
    h = lambda k: F.bit_xor(F.xxhash64("node", F.lit(k)))
    return steps.groupBy("entry").agg(F.struct(F.count("node"), F.min("node"), F.max("node"), h(1), h(2)).cast("string").alias("path"))


def merge_flows(old: DataFrame, new: DataFrame) -> DataFrame:
    """(entry, action): stored flows against traced ones (entry, path): keep where the path is the same, else update, insert or delete."""
    j = old.select("entry", F.col("path").alias("a")).join(new.select("entry", F.col("path").alias("b")), "entry", "full")
    return j.select("entry", F.when(F.col("a") == F.col("b"), "keep").when(F.col("b").isNull(), "delete").when(F.col("a").isNull(), "insert").otherwise("update").alias("action"))


def rebase(df: DataFrame, old: str, new: str) -> DataFrame:
    """All paths of a table moved to another root; other strings stay."""
    def move(c: str) -> Column:
        return F.when(F.startswith(F.col(c), F.lit(old.rstrip("/") + "/")), F.concat(F.lit(new.rstrip("/")), F.expr(f"substring(`{c}`, {len(old.rstrip('/')) + 1})"))).otherwise(F.col(c))

    return df.withColumns({c: move(c) for c, t in df.dtypes if t == "string" and (c.endswith("qualified") or c.endswith("_path") or c == "qualified_name")})


def relativise(path: Column, root: str) -> Column:
    """A path below its root."""
    return F.regexp_replace(path, "^" + root.rstrip("/") + "/", "")


def fits(df: DataFrame, order: list[str], text: str, budget: int) -> DataFrame:
    """(..., used): the longest prefix in an order whose texts fit a token budget (four characters a token, at least one).

    Each text costs a token or more, so that the prefix lies within the first `budget` rows. Costs are summed in two levels: per
    range of the sorted rows, then within a range, so that no task holds more than a range, whatever the budget."""
    cost = F.greatest(F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4.0), F.lit(1))
    first = df.orderBy(*order).limit(budget).withColumn("_cost", cost).repartitionByRange(*order)
    parts = materialise(first.withColumn("_part", F.spark_partition_id()), "prefix")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = parts.groupBy("_part").agg(F.sum("_cost").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    used = parts.join(F.broadcast(base), "_part").withColumn("used", F.col("_base") + F.sum("_cost").over(w))
    return used.where(F.col("used") <= budget).drop("_part", "_base", "_cost")
