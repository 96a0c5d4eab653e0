"""Per-key results where a few keys hold most records.

Everything here is distributed exact selection over mergeable counts: values (or hashes of keys) fall into the bins of a
histogram, partial counts are merged, the bin that holds the wanted rank is refined, until ranks resolve. Values of a hot key
are never gathered: a task sees counts of bins.

Defined results: rows with a null key are in no group; rows with a null id count nowhere; ids delivered again count once, and one that comes with several values counts once for each; an
empty table gives no groups. Null values are not ranked, and a key of null values only has null quantiles. Ties share a rank
range, so the quantile is the value at rank ceil(p * n). Further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise

DIGIT_BITS = 16
BINS = 64
#: State rows up to this number are broadcast; beyond it the join is salted.
BROADCAST_ROWS = 200_000
SALTS = 16


def heavy_keys(rows: DataFrame, keys: Sequence[str], id_col: str, share: float) -> DataFrame:
    """Key combinations that hold at least `share` of all distinct ids, with their number of ids.

    A combination is a 64-bit hash. Its digits are resolved from the left: ids are counted per value of the next 16 bits, and
    only prefixes with enough ids (at most 1/share of them, whatever the data) go on. No combination with enough ids can be
    lost, as each prefix holds at least the ids of the combinations under it. The last step counts real keys, so that two
    combinations with one hash are told apart.
    """
    keys = list(keys)
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    h = F.when(whole, F.xxhash64(*keys))
    ids = materialise(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), h.alias("h")).distinct(), "ids")
    total = ids.agg(F.count_distinct("id")).first()[0]
    least = max(1, math.ceil(Fraction(str(share)) * total))
    prefixes: list[int] | None = None
    for bits in range(DIGIT_BITS, 65, DIGIT_BITS):
        shift = 64 - bits
        left = ids.where("h is not null")
        if prefixes is not None:
            left = left.where(F.shiftright("h", shift + DIGIT_BITS).isin(prefixes))
        counts = left.groupBy(F.shiftright("h", shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        prefixes = [r.prefix for r in counts.collect()]  # at most 1/share rows
        if not prefixes:
            break
    hit = rows.where(F.col(id_col).isNotNull() & whole & h.isin(prefixes or []))
    real = hit.groupBy(h.alias("h"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    counted = ids.where(F.col("h").isin(prefixes or [])).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    shared = real.groupBy("h").count().where("count > 1").limit(1).count() if prefixes else 0
    if shared:  # two combinations under one hash: count each by its ids
        n = hit.select(*keys, id_col).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    else:
        n = real.join(F.broadcast(counted), "h").select(*keys, "n")
    return n.where(F.col("n") >= least)


def exact_quantiles(counts: DataFrame, keys: Sequence[str], value: str, n: str, probs: Sequence[float]) -> DataFrame:
    """(keys, p, q): the value at rank ceil(p * rows) of each key, from mergeable counts (keys, value, n), values distinct per key.

    Each (key, p) has a bracket. A round cuts it into BINS bins, merges counts per bin, and keeps the bin that holds the rank,
    tightened to the least and greatest value seen in it; one value left resolves the rank.
    """
    keys = list(keys)
    v = counts.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), F.col(n).alias("n"))
    whole = v.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    probs_col = F.array(*[F.lit(float(p)) for p in probs])
    state = whole.withColumn("p", F.explode(probs_col)).select(*keys, "p", F.greatest(F.ceil(F.col("p") * F.col("rows")), F.lit(1)).cast("long").alias("rank"), "lo", "hi")
    done, left = [], materialise(state, "brackets")
    while True:
        done.append(left.where("lo = hi").select(*keys, "p", F.col("lo").alias("q")))
        left = left.where("lo < hi")
        size = left.count()
        if not size:
            break
        if size <= BROADCAST_ROWS:
            j = v.join(F.broadcast(left), keys)
        else:
            salted = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            j = v.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"])
        inside = j.where("v between lo and hi")
        width = (F.col("hi") / BINS - F.col("lo") / BINS)
        b = F.least(F.lit(BINS - 1), F.floor((F.col("v") - F.col("lo")) / width)).cast("int")
        hist = inside.withColumn("b", F.when(F.col("v") == F.col("hi"), F.lit(BINS - 1)).otherwise(F.coalesce(b, F.lit(0)))).groupBy(*keys, "p", "rank", "b").agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        w = Window.partitionBy(*keys, "p").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most BINS rows
        cum = hist.withColumn("upto", F.sum("n").over(w))
        left = materialise(cum.where("upto >= rank and upto - n < rank").select(*keys, "p", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi"), "brackets")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def key_profile(edges: DataFrame, probs: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """Per (kind, target_qualified): edges, callers, files and quantiles of `line`.

    Edges are made unique by id, then summed per (key, caller, file, line), a grouping in which the rows of a hot key lie in
    all partitions; each result is summed from there in two steps. Keys travel as 128-bit, callers and files as 64-bit hashes,
    so that all aggregations are over numbers; the names of keys are joined to the result.
    """
    rows = edges.where("id is not null and kind is not null and target_qualified is not null")
    k1, k2 = F.xxhash64("kind", "target_qualified"), F.xxhash64("target_qualified", "kind", F.lit("second"))
    h = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    keys = ["k1", "k2"]
    slim = rows.select("id", k1.alias("k1"), k2.alias("k2"), h("source_qualified").alias("s"), h("file_path").alias("f"), F.col("line").cast("long").alias("line"))
    once = slim.distinct()  # rows given again are equal
    cells = materialise(once.groupBy(*keys, "s", "f", "line").agg(F.count(F.lit(1)).alias("n")), "cells")
    callers = cells.where("s is not null").groupBy(*keys, "s").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("callers"))
    files = cells.where("f is not null").groupBy(*keys, "f").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("files"))
    lines = cells.groupBy(*keys, "line").agg(F.sum("n").alias("n"))
    q = exact_quantiles(lines, keys, "line", "n", probs).groupBy(*keys).agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(f"line_p{round(p * 100)}") for p in probs])
    names = rows.select("kind", "target_qualified").distinct().select(k1.alias("k1"), k2.alias("k2"), "kind", "target_qualified")
    n = cells.groupBy(*keys).agg(F.sum("n").alias("edges"))
    out = names.join(n, keys).join(callers, keys, "left").join(files, keys, "left").join(q, keys, "left")
    return out.select("kind", "target_qualified", "edges", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("files", F.lit(0)).alias("files"), *[f"line_p{round(p * 100)}" for p in probs])
