"""Keyword, vector and fused ranking. All queries of a batch are answered together: queries(query_id, query)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules

TOKEN = r"[\p{L}\p{N}_]+"
RRF_K = 60
#: Query vectors up to this number of values are sent to every task; more are answered in blocks.
QUERY_VALUES = 4_000_000
#: Queries of one block of a keyword search.
QUERY_BATCH = 1_000


def tokens(c: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, term, tf, dl): an inverted index; a document's terms are counted before they are shuffled."""
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    return d.select("doc", "dl", F.explode("ts").alias("term")).groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf")).select("doc", "term", "tf", "dl")


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", limit: int | None = 20, every_term: bool = True) -> DataFrame:
    """(query_id, doc, score, place): BM25 (k1 1.2, b 0.75, idf ln(1 + (N - df + .5)/(df + .5))); every_term keeps documents with all terms of the query. Ties by document.

    Only postings of asked terms leave the scan; the terms are a broadcast list, bounded by the batch of queries."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"))
    d = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
    total = d.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    p = d.select("doc", "dl", F.explode("ts").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    s = p.join(df, "term").join(F.broadcast(total)).join(asked, "term")  # a single row
    idf = F.log((F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)) + 1)
    part = idf * F.col("tf") * F.lit(2.2) / (F.col("tf") + F.lit(1.2) * (F.lit(0.25) + F.lit(0.75) * F.col("dl") / F.col("avgdl")))
    g = s.withColumn("part", part).groupBy("query_id", "doc").agg(F.round(F.sum("part"), 4).alias("score"), F.count(F.lit(1)).alias("terms"))
    if every_term:
        g = g.join(wanted, "query_id").where("terms = wanted")
    return top(g.select("query_id", "doc", "score"), limit)


def top(scored: DataFrame, limit: int | None) -> DataFrame:
    """(query_id, doc, score, place): the first per query; within salts first, so that no query gathers all documents."""
    if limit is None:
        return scored.withColumn("place", F.lit(None).cast("int"))
    w1 = Window.partitionBy("query_id", "salt").orderBy(F.desc("score"), "doc")
    w2 = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")  # at most 32 times the limit
    s = scored.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(32))).withColumn("r", F.row_number().over(w1)).where(F.col("r") <= limit)
    return s.withColumn("place", F.row_number().over(w2)).where(F.col("place") <= limit).select("query_id", "doc", "score", "place")


def search_or_relax(docs: DataFrame, queries: DataFrame, key: str, text: str, limit: int = 20) -> DataFrame:
    """As bm25; a query without a document of all terms is asked again for any term, stop words aside (relaxed)."""
    strict = bm25(docs, queries, key, text, limit).withColumn("relaxed", F.lit(False))
    left = queries.join(strict.select("query_id").distinct(), "query_id", "left_anti")
    words = F.array_join(F.filter(tokens(F.col("query")), lambda w: ~w.isin(rules.STOP_WORDS)), " ")
    again = bm25(docs, left.select("query_id", words.alias("query")), key, text, limit, every_term=False).withColumn("relaxed", F.lit(True))
    return strict.unionByName(again)


def keyword_nodes(n: DataFrame, queries: DataFrame, limit: int = 50) -> DataFrame:
    """(query_id, doc, score, place): words found in names, 10 each, and 3 for the exact name, 2 for its beginning, else 1.

    Words of four letters or more admit a node, shorter ones only rank it; sentences leave files aside. Blocks of at most
    QUERY_BATCH queries are sent to a scan of all nodes."""
    blocks = max(1, -(-queries.count() // QUERY_BATCH))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = _keyword_block(n, numbered.where(F.col("block") == b).drop("block"), limit)
        out = part if out is None else out.unionByName(part)
    return out


def _keyword_block(n: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    q = queries.select("query_id", F.lower("query").alias("query")).withColumn("words", F.filter(F.split("query", r"\s+"), lambda w: w != ""))
    long_words = F.filter("words", lambda w: F.length(w) > 3)
    q = q.withColumn("admit", F.when((F.size("words") > 1) & (F.size(long_words) > 0), long_words).otherwise(F.col("words")))
    s = n.select("id", "kind", F.lower("name").alias("name"), F.lower("qualified_name").alias("qn")).join(F.broadcast(q))  # about QUERY_BATCH rows
    symbol = F.when(F.size("words") > 1, F.expr("substring(qn, instr(qn, '::') + 2)")).otherwise(F.col("qn"))
    s = s.withColumn("symbol", F.when(F.instr("qn", "::") > 0, symbol).otherwise(F.when(F.size("words") > 1, F.expr("substring(qn, 2)")).otherwise(F.col("qn"))))
    has = lambda arr: F.size(F.filter(arr, lambda w: F.contains(F.col("name"), w) | F.contains(F.col("symbol"), w)))
    s = s.where((F.size("words") == 1) | (F.col("kind") != "File")).withColumn("hits", has(F.col("words"))).withColumn("ok", has(F.col("admit"))).where("ok > 0")
    score = F.col("hits") * 10 + F.when(F.col("name") == F.col("query"), 3.0).when(F.startswith("name", "query"), 2.0).otherwise(1.0)
    return top(s.select("query_id", F.col("id").alias("doc"), score.alias("score")), limit)


#: What counts as an identifier within a sentence: dotted, snake_case, CamelCase.
IDENTIFIERS = (r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\b", r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", r"\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\b")


def node_text(n: DataFrame) -> DataFrame:
    """(id, text): what is searched of a node: its name, the words of it, its qualified name and its signature."""
    parts = ["name", F.array_join(rules.split_words(F.col("name")), " "), "qualified_name", rules.signature(F.col("kind"), F.col("name"), F.col("params"), F.col("return_type"))]
    return n.select("id", F.concat_ws(" ", *parts).alias("text"))


def boost(query: Column, kind: Column, qualified: Column) -> Column:
    """The factor by which the spelling of a query favours a node: 1.5 for its kind, 2 for a dotted query within the qualified name, 2 for an identifier of the query within it."""
    q, name = F.trim(query), F.lower(qualified)
    found = F.filter(F.concat(*[F.regexp_extract_all(q, F.lit(p), F.lit(0)) for p in IDENTIFIERS]), lambda w: F.length(w) >= 3)
    factor = F.when(kind.isin("Class", "Type") & q.rlike("^[A-Z][a-z]"), 1.5).otherwise(1.0) * F.when((kind == "Function") & F.contains(q, F.lit("_")) & q.rlike("[A-Za-z]"), 1.5).otherwise(1.0)
    dotted = F.when(F.contains(q, F.lit(".")) & F.contains(name, F.lower(query)), 2.0).otherwise(1.0)
    return factor * dotted * F.when(F.exists(found, lambda w: F.contains(name, F.lower(w))), 2.0).otherwise(1.0)


def hybrid(n: DataFrame, queries: DataFrame, by_vector: DataFrame | None = None, limit: int = 20, kind: str | None = None, context_files: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, place, mode): nodes by keyword rank and vector rank, fused, weighed by what the query's spelling and the files at hand favour, of one kind if asked.

    Each list holds three times the limit, so that a filter leaves enough. Queries that neither list answers are answered by parts of
    names. by_vector(query_id, doc, place) comes from `nearest`; context_files(file_path) weigh 1.5."""
    more = 3 * limit
    by_word = bm25(node_text(n), queries, "id", "text", more)
    lists = [by_word] if by_vector is None else [by_word, by_vector.where(F.col("place") <= more)]
    fused = fuse(*lists)
    flag = lambda x, name: x.select("query_id").distinct().withColumn(name, F.lit(True))
    modes = flag(by_word, "w") if by_vector is None else flag(by_word, "w").join(flag(by_vector, "v"), "query_id", "full")
    mode = (F.when(F.col("w").isNotNull(), "fts") if by_vector is None else F.when(F.col("w").isNotNull() & F.col("v").isNotNull(), "hybrid").when(F.col("w").isNotNull(), "fts")).otherwise("semantic")
    answered = modes.select("query_id", mode.alias("mode"))
    left = queries.join(answered, "query_id", "left_anti")
    words = keyword_nodes(n, left, more).select("query_id", "doc", "score").withColumn("mode", F.lit("keyword"))
    every = fused.join(answered, "query_id").unionByName(words)
    j = every.join(n.select(F.col("id").alias("doc"), "kind", "qualified_name", "file_path"), "doc").join(queries, "query_id")
    j = j if kind is None else j.where(F.col("kind") == kind)
    factor = boost(F.col("query"), F.col("kind"), F.col("qualified_name"))
    if context_files is not None:
        j = j.join(context_files.select("file_path", F.lit(True).alias("at_hand")).distinct(), "file_path", "left")
        factor = factor * F.when(F.col("at_hand"), 1.5).otherwise(1.0)
    scored = j.select("query_id", "doc", F.round(F.col("score") * factor, 9).alias("score"), "mode")
    return top(scored, limit).join(scored.select("query_id", "mode").distinct(), "query_id").select("query_id", "doc", "score", "place", "mode")


def memory_hybrid(o: DataFrame, queries: DataFrame, by_vector: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """(query_id, doc, score, place): observations (already filtered) that hold all words of a query, else any of them, fused with a vector ranking if there is one; ties by id."""
    text = o.select("id", F.concat_ws(" ", "title", F.coalesce("body", F.lit(""))).alias("text"))
    words = search_or_relax(text, queries, "id", "text", 3 * limit)
    lists = [words] if by_vector is None else [words, by_vector.where(F.col("place") <= 3 * limit).join(o.select(F.col("id").alias("doc")), "doc", "left_semi")]
    return top(fuse(*lists), limit)


def fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc, score): reciprocal rank fusion of ranked lists (query_id, doc, place from 1)."""
    every = lists[0].select("query_id", "doc", "place")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", "doc", "place"))
    return every.groupBy("query_id", "doc").agg(F.round(F.sum(F.lit(1.0) / (F.col("place") + k)), 9).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", least: float = -1.0) -> DataFrame:
    """(query_id, doc, score, place): exact cosine k nearest of each query vector, itself aside, ties by key. queries(query_id, v).

    All rows are scanned once per block of queries, as matrix products in batches; each batch sends on k rows a query."""
    spark = vectors.sparkSession
    width = queries.select(F.size("v").alias("w")).limit(1).collect()
    if not width:
        return spark.createDataFrame([], "query_id bigint, doc bigint, score double, place int")
    per = max(1, QUERY_VALUES // max(1, width[0].w))
    n = queries.count()
    blocks = max(1, -(-n // per))
    numbered = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).select("query_id", "v").toPandas()  # about QUERY_VALUES values
        if rows.empty:
            continue
        m = np.array(rows["v"].tolist(), np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), m / np.where(norms == 0, 1, norms)))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, qm = shared.value
            for pdf in batches:
                x = np.array(pdf["v"].tolist(), np.float64)
                nx = np.linalg.norm(x, axis=1, keepdims=True)
                sim = np.round(qm @ (x / np.where(nx == 0, 1, nx)).T, 6)
                docs = pdf["doc"].to_numpy()
                sim[(ids[:, None] == docs[None, :]) | (sim < least)] = -2.0
                most = min(k, sim.shape[1])
                kth = np.partition(sim, sim.shape[1] - most, axis=1)[:, -most]
                qi, di = np.nonzero((sim >= kth[:, None]) & (sim > -2.0))  # ties of the k-th go on too
                if len(qi):
                    yield pd.DataFrame({"query_id": ids[qi], "doc": docs[di], "score": sim[qi, di]})

        part = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == m.shape[1])).select(F.col(key).alias("doc"), F.col(vector).alias("v")).mapInPandas(scan, "query_id bigint, doc bigint, score double")
        out = part if out is None else out.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")  # k rows a batch
    return out.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def usable(rows: DataFrame) -> DataFrame:
    """(provider, name, v): one vector per provider and name, the least of those that are of the provider's commonest width, finite and not all zero."""
    v = F.col("vector")
    fine = rows.where("provider is not null and qualified_name is not null and size(vector) > 0").select("provider", F.col("qualified_name").alias("name"), v.alias("v"))
    widths = fine.groupBy("provider", F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n")).groupBy("provider").agg(F.max_by("width", F.struct("n", -F.col("width"))).alias("width"))  # a row per provider
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    return fine.join(F.broadcast(widths), "provider").where("size(v) = width").groupBy("provider", "name").agg(F.min("v").alias("v"))


def embedding_text(n: DataFrame) -> DataFrame:
    """(qualified_name, text, text_hash): what is embedded of a symbol: its dotted name, words, kind, parent, signature, directory, language."""
    words = F.array_join(rules.split_words(F.col("name")), " ")
    dotted = F.concat_ws(".", "parent_name", "name")
    text = F.concat_ws(" ", dotted, words, F.lower("kind"), F.concat(F.lit("in "), F.col("parent_name")), F.col("params"), F.concat(F.lit("returns "), F.col("return_type")), F.regexp_extract("file_path", "([^/]+)/[^/]*$", 1), "language")
    return n.where("kind <> 'File'").select("qualified_name", text.alias("text"), F.sha2(text, 256).alias("text_hash"))


def stale_texts(texts: DataFrame, vectors: DataFrame, provider: str) -> DataFrame:
    """Texts to embed (again): those without a vector of the provider, or whose vector is of another text. texts(qualified_name, text, text_hash)."""
    have = vectors.where(F.col("provider") == provider).select("qualified_name", "text_hash").distinct()
    return texts.join(have, ["qualified_name", "text_hash"], "left_anti")


def grep_rank(files: DataFrame, terms: list[str], k: int = 10, key: str = "file_path", text: str = "content") -> DataFrame:
    """(doc, hits): files with the most occurrences of the terms, ties by path (a top-k report)."""
    hits = F.lit(0)
    for t in terms:
        hits = hits + F.size(F.split(F.lower(text), re.escape(t.lower()))) - 1
    return files.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), hits.alias("hits")).where("hits > 0").orderBy(F.desc("hits"), "doc").limit(k)
