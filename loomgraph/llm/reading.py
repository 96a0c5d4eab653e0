"""Reading level of each document.

Method: documents and their words form a bipartite graph. Graded documents are clamped to their (mean) grade; difficulty then
spreads in harmonic iterations: a word takes the mean difficulty of its documents, a document the mean of its words, rescaled
to the spread of the grades. Cuts between the levels are placed where graded documents, judged by their words alone, are
misjudged least; they come from a histogram over all grades.

A document is one row of word ids; a step reads these rows once, sums per word within each batch and merges the sums, so that
a word in every document costs one row per batch. Scores of words are sent to the tasks if the vocabulary has at most
MAX_WORDS words, else joined.

Layout is no part of the level: fenced code, inline code, links and identifiers are left out, and words count once per document.
English is told from German, French and Spanish by their function words, whatever `lang` says.

Defined results: documents with a null text or n_chars below the least length have no row; a document without any known word
gets the mean level; null grades are ignored and several grades of a document averaged; without any grade every document gets
level 2; repeated doc_ids count once; an empty table gives no rows; further columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialise

LEAST_CHARS, ITERATIONS, PRIOR, CUT_BINS = 250, 5, 1.0, 400
#: Words up to this number are sent to every task (two arrays of 8 bytes a word, at most 16 MB); beyond it they are joined.
MAX_WORDS = 1_000_000

# Function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from or an which not you at its has but their every each when we they there can will if than then so do what".split(),
    "de": "der die das und ist nicht ein eine einen zu mit den dem des von für auf im sich auch wird jede jeder wenn sie es wir ohne danach oder aber bei nach aus".split(),
    "fr": "le la les des et est une un pour dans que qui pas sur au avec par ne ce cette chaque il nous du en sans puis ou mais si aux".split(),
    "es": "el los las una un para que por con del se es como más pero cada su no lo al en y de si desde sin luego la".split(),
}
_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_ANY_LANGUAGE = frozenset().union(*_SETS.values())
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|https?://\S+|\S*[_/\\]\S*|\b\w+\(\S*\)", re.S)
_WORD = re.compile(r"[^\W\d_]{2,}")


def words_of(text: str) -> list[str]:
    """Lower-case words of a text, code and identifiers aside."""
    return _WORD.findall(_CODE.sub(" ", text).lower())


def is_english(words: list[str]) -> bool:
    """More function words of English than of any other of the four languages; without any function word, plain ASCII words count as English."""
    known = [w for w in words if w in _ANY_LANGUAGE]
    if not known:
        return bool(words) and all(w.isascii() for w in words)
    n = {k: sum(w in s for w in known) for k, s in _SETS.items()}
    return all(n["en"] > v for k, v in n.items() if k != "en")


def english_words(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, words): distinct words of each English document of enough characters."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, out = [], []
            for i, t in zip(b["doc_id"], b["text"]):
                w = words_of(t)
                if is_english(w):
                    ids.append(i)
                    out.append(sorted(set(w)))
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "words": out})

    rows = documents.where((F.coalesce("n_chars", F.length("text")) >= least_chars) & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.dropDuplicates(["doc_id"]).mapInPandas(read, "doc_id bigint, words array<string>")


def hashed(words: str) -> Column:
    """Words as 64-bit hashes: 8 bytes each in every step."""
    return F.transform(words, lambda w: F.xxhash64(w))


def harmonic(docs: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, grade, score): difficulty from the words of each document. docs(doc_id, words, grade), grade null where not graded; words as text or as 64-bit hashes."""
    if docs.schema["words"].dataType.elementType.simpleString() == "string":
        docs = docs.withColumn("words", hashed("words"))
    spark = docs.sparkSession
    m = docs.agg(F.avg("grade").alias("m"), F.stddev_pop("grade").alias("s")).first()
    mean, spread = (m.m if m.m is not None else 2.0), (m.s or 0.0)
    words = materialise(docs.select(F.explode("words").alias("word")).distinct(), "words")
    small = words.count() <= MAX_WORDS
    scores, shift, scale = None, 0.0, 1.0
    for k in range(iterations):
        if scores is None:
            part = docs.where("grade is not null").select("words", F.col("grade").alias("y"))
        else:
            s = (F.col("score") - shift) * scale + mean
            part = scored.select("words", F.coalesce("grade", s).alias("y"))  # noqa: F821
        sums = part.select(F.explode("words").alias("word"), "y").groupBy("word").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        scores = sums.select("word", ((F.col("y") + PRIOR * mean) / (F.col("n") + PRIOR)).alias("w"))
        scored = _score(spark, docs, scores, small, mean)
        if k + 1 < iterations:
            scored = materialise(scored, "scored")
            g = scored.where("grade is not null").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s")).first()
            shift, scale = (g.m if g.m is not None else mean), (spread / g.s if g.s else 1.0)
    return scored.select("doc_id", "grade", "score")


def _score(spark, docs: DataFrame, scores: DataFrame, small: bool, mean: float) -> DataFrame:
    if not small:
        by = docs.select("doc_id", F.explode("words").alias("word")).join(scores, "word", "left").groupBy("doc_id").agg(F.avg(F.coalesce("w", F.lit(mean))).alias("score"))
        return docs.join(by, "doc_id", "left").withColumn("score", F.coalesce("score", F.lit(mean)))
    table = scores.toPandas().sort_values("word")  # at most MAX_WORDS hashes and scores
    shared = spark.sparkContext.broadcast((table["word"].to_numpy(np.int64), table["w"].to_numpy(np.float64)))

    @F.pandas_udf("double")
    def mean_of(ws: pd.Series) -> pd.Series:
        known, score = shared.value
        lens = ws.map(len).to_numpy(np.int64)
        out = np.full(len(ws), mean)
        some = lens > 0
        if some.any() and len(known):
            flat = np.concatenate(ws[some].to_list())
            at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
            values = np.where(known[at] == flat, score[at], mean)
            out[some] = np.add.reduceat(values, np.r_[0, np.cumsum(lens[some])[:-1]]) / lens[some]
        return pd.Series(out)

    return docs.withColumn("score", mean_of("words"))


def place_cuts(graded: DataFrame, levels: tuple[int, ...] = (1, 2, 3, 4)) -> list[float]:
    """Scores that divide the levels with the fewest graded documents on the wrong side, from a histogram of all of them."""
    r = graded.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    if r.lo is None:
        return [1.5, -np.inf * -1, np.inf]
    lo, width = r.lo, max((r.hi - r.lo) / CUT_BINS, 1e-9)
    b = F.least(F.floor((F.col("score") - lo) / width), F.lit(CUT_BINS - 1)).cast("int")
    rows = graded.groupBy(b.alias("b"), F.col("grade")).count().collect()  # bins times grades
    cuts = []
    for k in levels[:-1]:
        up, down = np.zeros(CUT_BINS + 1), np.zeros(CUT_BINS + 1)
        for x in rows:
            (up if x.grade > k + 0.5 else down)[x.b + 1] += x["count"] if abs(x.grade - k - 0.5) > 1e-9 else 0
        wrong = np.cumsum(up) + (down.sum() - np.cumsum(down))  # cut at the upper edge of bin i - 1
        best = np.flatnonzero(wrong == wrong.min())
        cuts.append(float(lo + width * (best[0] + best[-1]) / 2))
    return list(np.maximum.accumulate(cuts))


def reading_levels(documents: DataFrame, labels: DataFrame, least_chars: int = LEAST_CHARS, iterations: int = ITERATIONS) -> DataFrame:
    """(doc_id, level, score) of every English document of enough characters."""
    grades = labels.where("level is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.avg("level").alias("grade"))
    docs = materialise(english_words(documents, least_chars).withColumn("words", hashed("words")).join(grades, "doc_id", "left"), "doc_words")
    if docs.where("grade is not null").limit(1).count() == 0:
        return docs.select("doc_id", F.lit(2).alias("level"), F.lit(2.0).alias("score"))
    scored = materialise(harmonic(docs, iterations), "levels")
    level = F.lit(1)
    for c in place_cuts(scored.where("grade is not null")):
        level = level + (F.col("score") > F.lit(c)).cast("int")
    return scored.select("doc_id", level.cast("int").alias("level"), "score")
