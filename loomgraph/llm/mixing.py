"""Mixing sources to target weights.

Method: the tokens of each source are packed, in a fixed order of its documents, into blocks of a fixed length; the last one may be
short. The slots of a source are the passes and blocks that meet its quota. A pseudorandom permutation of all slots, made from the
seed alone, gives each its shard and place: the sources of a shard are so a multinomial draw conditioned on the quotas (shards are
random, totals are not), drawn where the slots are made and not on the driver. The r-th slot of a pass is mapped to a block through
a pseudorandom permutation of the full blocks of its source, another one in each pass; the short block ends the pass. A source is
passed at most max_repeats times. Slots and blocks are joined by index.

No source is gathered: positions of documents come from two-level sums (source and bucket, then within a bucket), so a source
that holds most rows is spread over many buckets; its slots are made in runs of RUN. Any number of sources may be given.

Defined results: null and empty texts have no tokens and are not used; documents with a null source, or one that is not among
the targets, are not used and are reported with target 0 (under the source null); a document without a doc_id cannot be named
and is not used, its tokens are reported as tokens_without_id; a target without documents is reported with 0 tokens; a null or
non-positive share counts as 0 and a null max_repeats as 1; a source given twice among targets counts with the sum of its
shares and the least max_repeats; of several rows of one doc_id the one of the least source and fewest tokens counts; a source
with a share and tokens has one block at least; what misses a quota (rounding to blocks, or the cap) is reported as
tokens_missing; an empty table gives reports only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.resources import TOKENIZERS
from loomgraph.llm.tokens import encode_corpus
from loomgraph.session import materialise

BLOCK, SHARD_SLOTS, RUN = 512, 4096, 65_536
BUCKET_ROWS = 20_000


def permute(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at the places i: a Feistel network on the next power of four, walked until inside."""
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    half, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    keys = np.random.default_rng(seed).integers(1, 2**63, 4, dtype=np.uint64)

    def round_trip(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for k in keys:
            m = (b + k) * np.uint64(0x9E3779B97F4A7C15)
            a, b = b, a ^ ((m ^ (m >> np.uint64(31))) & mask)
        return (a << half) | b

    x = round_trip(i.astype(np.uint64))
    while (out := x >= n).any():
        x[out] = round_trip(x[out])
    return x.astype(np.int64)


def token_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, n): tokens of each row; texts are encoded where they lie and only numbers leave."""
    return encode_corpus(documents, "doc_id", tokenizer_dir, keep=["source"]).select("doc_id", "source", F.size("ids").cast("long").alias("n"))


def unique_sizes(sizes: DataFrame) -> DataFrame:
    """(doc_id, source, n): one row per doc_id, that of the least source and fewest tokens."""
    return sizes.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("source", "n")).alias("x")).select("doc_id", "x.*")


def pack(sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, block, doc_id, doc_from, doc_to, at): the pieces of documents in each block of a source, by token positions."""
    rows = sizes.where("source is not null and n > 0").withColumn("h", F.xxhash64("doc_id"))
    buckets = max(1, math.ceil(rows.count() / BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    per = rows.groupBy("source", "bucket").agg(F.sum("n").alias("bucket_n"))
    before = per.withColumn("base", F.sum("bucket_n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("source", "bucket", F.coalesce("base", F.lit(0)).alias("base"))
    w = Window.partitionBy("source", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.withColumn("within", F.coalesce(F.sum("n").over(w), F.lit(0))).join(before, ["source", "bucket"]).select("source", "doc_id", "n", (F.col("base") + F.col("within")).alias("start"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block)
    cut = at.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    lo = F.greatest(F.col("block") * block - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block - F.col("start"), F.col("n"))
    return cut.select("source", "block", "doc_id", lo.alias("doc_from"), hi.alias("doc_to"), (F.col("start") + lo - F.col("block") * block).alias("at"))


def plan(targets: DataFrame, sizes: DataFrame, total: int | None, block: int) -> DataFrame:
    """(source, target_share, max_repeats, tokens, without_id, quota, full, per_pass, passes, extra, slots, used): one row per source.

    A quota is met by whole passes, then by the nearest number of blocks of the next one."""
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    t = targets.where("source is not null").groupBy("source").agg(F.sum(share).alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    named = unique_sizes(sizes).groupBy("source").agg(F.sum("n").alias("tokens"))
    lost = sizes.where("doc_id is null").groupBy("source").agg(F.sum("n").alias("without_id"))
    have = named.join(lost.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "full").select(F.coalesce("source", "s").alias("source"), "tokens", "without_id")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0)).cast(kind).alias(c)
    rows = materialise(t.join(have, "source", "full").select("source", zero("target_share", "double"), zero("max_repeats", "int"), zero("tokens", "long"), zero("without_id", "long")), "sources")
    sums = rows.agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("shares"), F.coalesce(F.sum(F.when(F.col("target_share") > 0, F.col("tokens"))), F.lit(0)).alias("listed")).first()
    size = int(sums.listed) if total is None else total
    quota = F.col("target_share") / F.lit(max(sums.shares, 1e-300)) * F.lit(float(size))
    p = rows.withColumn("quota", quota).withColumn("full", F.floor(F.col("tokens") / block)).withColumn("per_pass", F.ceil(F.col("tokens") / block))
    some = (F.col("tokens") > 0) & (F.col("quota") > 0) & (F.col("max_repeats") > 0)
    p = p.withColumn("passes", F.when(some, F.least(F.floor(F.col("quota") / F.col("tokens")), F.col("max_repeats"))).otherwise(0).cast("long"))
    left = F.when(some & (F.col("passes") < F.col("max_repeats")), F.col("quota") - F.col("passes") * F.col("tokens")).otherwise(0.0)
    p = p.withColumn("extra", F.least(F.floor(left / block + 0.5), F.col("per_pass")).cast("long"))
    p = p.withColumn("extra", F.when(some & (F.col("passes") + F.col("extra") == 0), 1).otherwise(F.col("extra")))
    p = p.withColumn("slots", F.col("passes") * F.col("per_pass") + F.col("extra"))
    return p.withColumn("used", F.col("passes") * F.col("tokens") + F.when(F.col("extra") == F.col("per_pass"), F.col("tokens")).otherwise(F.col("extra") * block))


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, shards: int | None = None, seed: int = 7, tokenizer_dir: str = TOKENIZERS, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture(shard, slot, source, pass, block, doc_id, doc_from, doc_to, at): the pieces of documents (token positions) of each
    slot. report(source, target_share, actual_share, tokens_used, tokens_available, tokens_missing, tokens_without_id, passes,
    max_repeats). Sizes (doc_id, source, n) may be given in another unit than tokens."""
    sizes = materialise(token_counts(documents, tokenizer_dir) if sizes is None else sizes.select("doc_id", "source", F.col("n").cast("long").alias("n")), "sizes")
    rows = materialise(plan(targets, sizes, total, block), "plan")
    sums = rows.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.coalesce(F.sum("used"), F.lit(0)).alias("used")).first()
    n = int(sums.n)
    per_shard = SHARD_SLOTS if shards is None else max(1, math.ceil(n / shards))
    w = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)  # a row per source
    runs = rows.where("slots > 0").withColumn("offset", F.coalesce(F.sum("slots").over(w), F.lit(0)))
    runs = runs.select("source", "full", "per_pass", "slots", "offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(RUN).cast("long"))).alias("first")).repartition("source", "first")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                i = np.arange(r.first, min(r.first + RUN, r.slots), dtype=np.int64)
                p, at = i // r.per_pass, i % r.per_pass
                out = at.copy()  # the short block, if any, stays the last of a pass
                for q in np.unique(p):
                    m = (p == q) & (at < r.full)
                    out[m] = permute(at[m], r.full, _seed(r.source, int(q), seed))
                place = permute(i + r.offset, n, seed)
                yield pd.DataFrame({"shard": place // per_shard, "slot": (place % per_shard).astype("int32"), "source": r.source, "pass": p.astype("int32"), "block": out})

    placed = runs.mapInPandas(slots, "shard bigint, slot int, source string, pass int, block bigint")
    mixture = placed.join(pack(unique_sizes(sizes), block), ["source", "block"]).select("shard", "slot", "source", "pass", "block", "doc_id", "doc_from", "doc_to", "at")
    share = F.col("used") / F.lit(max(int(sums.used), 1))
    report = rows.select(
        "source", "target_share", share.alias("actual_share"), F.col("used").cast("long").alias("tokens_used"), F.col("tokens").alias("tokens_available"),
        F.greatest(F.floor(F.col("quota") - F.col("used") + 0.5), F.lit(0)).cast("long").alias("tokens_missing"), F.col("without_id").alias("tokens_without_id"),
        F.when(F.col("tokens") > 0, F.col("used") / F.col("tokens")).otherwise(0.0).alias("passes"), "max_repeats",
    )
    return mixture, report


def _seed(source: str, q: int, seed: int) -> int:
    return xxhash.xxh64_intdigest(f"{source}\x00{q}\x00{seed}") & 0x7FFFFFFF
