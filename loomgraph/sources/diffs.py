"""Diffs and histories as tables: changed line ranges, commits per file, changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff_ranges(lines: DataFrame) -> DataFrame:
    """(diff_id, file_path, start, end) of unified diffs given as lines(diff_id, line_no, line).

    A hunk `+start,count` covers start to start + count - 1; a pure deletion (count 0) touches its start line; `/dev/null` has no ranges."""
    w = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    path = F.when(F.col("line").startswith("+++ "), F.regexp_replace(F.regexp_replace(F.substring("line", 5, 100_000), r"\t.*$", ""), "^b/", ""))
    x = lines.withColumn("file_path", F.last(path, ignorenulls=True).over(w)).where("line like '@@ %'")
    s = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 1)
    c = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", 2)
    start, n = s.cast("int"), F.when(c == "", F.lit("1")).otherwise(c).cast("int")
    return x.where((s != "") & F.col("file_path").isNotNull() & (F.col("file_path") != "/dev/null")).select("diff_id", "file_path", start.alias("start"), (start + F.greatest(n, F.lit(1)) - 1).alias("end"))


def numstat(lines: DataFrame) -> DataFrame:
    """(file_path, commits) of a history given as lines(line) of `added<TAB>removed<TAB>path`; binary files have dashes."""
    p = F.split("line", "\t")
    return lines.where(F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t.+")).groupBy(p[2].alias("file_path")).agg(F.count(F.lit(1)).alias("commits"))


def name_status(lines: DataFrame) -> DataFrame:
    """(file_path) of a change list given as lines(line) of `status<TAB>path[<TAB>new path]`; a rename gives both paths."""
    p = F.split("line", "\t")
    return lines.where(F.col("line").rlike(r"^[ACDMRTUX]\d*\t")).select(F.explode(F.slice(p, 2, F.size(p) - 1)).alias("file_path")).distinct()
