"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import handwritten, mixing, pii, reading, similar, tokens
from loomgraph.sources.tables import table

#: The company whose project these tables hold; its notices are no foreign ones.
OWNERS = ("Harborline",)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_all(table(spark, d, "observations"), pii.fit_names(table(spark, d, "contributors"))).select("id", "field", "pii_type", "start_pos")


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_all(table(spark, d, "observations"), pii.fit_names(table(spark, d, "contributors")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "source_files"), OWNERS).select("file_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return similar.similar_pairs(table(spark, d, "node_vectors"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of each symbol whose id is divisible by 50, against all."""
    asked = table(spark, d, "nodes").where("id % 50 = 0").select("qualified_name").distinct()
    v = table(spark, d, "node_vectors")
    queries = v.select("provider", "qualified_name").distinct().join(asked, "qualified_name", "left_semi").select("provider", F.col("qualified_name").alias("name"))
    return similar.nearest(v, queries=queries)


def p7_report_chars(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture whose sizes are characters, which SQL can count too."""
    docs = table(spark, d, "documents")
    sizes = docs.select("doc_id", "source", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    r = mixing.mix(docs, table(spark, d, "mix_targets"), sizes=sizes)[1]
    return r.withColumns({c: F.round(c, 9) for c in ("target_share", "actual_share", "passes")})


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "level_labels")).select("doc_id", "level")


QUERIES = {
    "p1_found": p1_found, "p1_redacted": p1_redacted, "p3_found": p3_found, "p4_found": p4_found, "p4_nearest": p4_nearest,
    "p6_ids": p6_ids, "p7_mixture": p7_mixture, "p7_report": p7_report, "p7_report_chars": p7_report_chars, "p8_found": p8_found,
}
ORACLE: dict[str, str] = {
    "p7_report_chars": """WITH d AS (SELECT doc_id, min(source) AS source, min(coalesce(length(text), 0)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY 1), a AS (SELECT source, sum(n) AS tokens FROM d GROUP BY 1),
t AS (SELECT source, sum(greatest(coalesce(target_share, 0), 0)) AS share, min(coalesce(max_repeats, 1)) AS r FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
j AS (SELECT coalesce(t.source, a.source) AS source, coalesce(share, 0)::double AS share, coalesce(r, 0) AS r, coalesce(tokens, 0)::bigint AS k FROM t FULL JOIN a ON t.source = a.source),
q AS (SELECT *, share / (SELECT sum(share) FROM j) * (SELECT sum(k) FROM j WHERE share > 0)::double AS quota, ceil(k / 512)::bigint AS pp FROM j),
p AS (SELECT *, CASE WHEN k > 0 AND quota > 0 AND r > 0 THEN least(floor(quota / k), r) ELSE 0 END::bigint AS passes FROM q),
x AS (SELECT *, least(floor(CASE WHEN k > 0 AND passes < r THEN quota - passes * k ELSE 0 END / 512 + 0.5::double), pp)::bigint AS e FROM p),
y AS (SELECT *, CASE WHEN k > 0 AND quota > 0 AND r > 0 AND passes + e = 0 THEN 1 ELSE e END AS extra FROM x),
u AS (SELECT *, passes * k + CASE WHEN extra = pp THEN k ELSE extra * 512 END AS used FROM y)
SELECT source, round(share, 9) AS target_share, round(used / (SELECT sum(used) FROM u), 9) AS actual_share, used::bigint AS tokens_used, k AS tokens_available, greatest(floor(quota - used + 0.5::double), 0)::bigint AS tokens_missing, 0::bigint AS tokens_without_id, round(CASE WHEN k > 0 THEN used / k ELSE 0 END, 9) AS passes, r::int AS max_repeats FROM u""",
}
