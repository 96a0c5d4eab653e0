"""Exports as rows of text, for any text sink, and scores of evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def xml(c: Column) -> Column:
    """Text safe inside XML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def cypher(c: Column) -> Column:
    """A quoted string of a Cypher statement; null is empty."""
    c = F.coalesce(c, F.lit(""))
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def graphml_rows(n: DataFrame, e: DataFrame) -> DataFrame:
    """(part, value): node and edge elements; edges between nodes only."""
    nodes = n.select(F.lit("node").alias("part"), F.concat(F.lit('<node id="'), xml(F.col("qualified_name")), F.lit('"><data key="kind">'), xml(F.col("kind")), F.lit("</data></node>")).alias("value"))
    edges = e.select(F.lit("edge").alias("part"), F.concat(F.lit('<edge source="'), xml(F.col("source_qualified")), F.lit('" target="'), xml(F.col("target_qualified")), F.lit('"><data key="kind">'), xml(F.coalesce("kind", F.lit(""))), F.lit("</data></edge>")).alias("value"))
    return nodes.unionByName(edges)


def cypher_rows(n: DataFrame, e: DataFrame) -> DataFrame:
    """(part, value): statements that create nodes, then edges."""
    nodes = n.select(F.lit("node").alias("part"), F.concat(F.lit("CREATE (:"), F.col("kind"), F.lit(" {qn: "), cypher(F.col("qualified_name")), F.lit("});")).alias("value"))
    edges = e.select(F.lit("edge").alias("part"), F.concat(F.lit("MATCH (a {qn: "), cypher(F.col("source_qualified")), F.lit("}), (b {qn: "), cypher(F.col("target_qualified")), F.lit("}) CREATE (a)-[:"), F.coalesce("kind", F.lit("UNKNOWN")), F.lit("]->(b);")).alias("value"))
    return nodes.unionByName(edges)


def json_rows(n: DataFrame) -> DataFrame:
    """(value): a JSON object per node; keys in a fixed order, nulls left out."""
    return n.select(F.to_json(F.struct("qualified_name", "kind", "name", "line_start")).alias("value"))


def compact_rows(n: DataFrame) -> DataFrame:
    """(value): one line per symbol, fields divided by a bar."""
    return n.select(F.concat_ws("|", "kind", "name", F.concat_ws(":", "file_path", "line_start")).alias("value"))


def super_nodes(members: DataFrame, n: DataFrame) -> DataFrame:
    """(community, symbols): size of each community, symbols in none under Uncategorized."""
    j = n.where("kind <> 'File'").select("qualified_name").join(members, "qualified_name", "left")
    return j.groupBy(F.coalesce("community", F.lit("Uncategorized")).alias("community")).agg(F.count(F.lit(1)).alias("symbols"))


def wiki_rows(members: DataFrame, tops: DataFrame, sizes: DataFrame) -> DataFrame:
    """(community, value): a page per community with its size and its main symbols."""
    lines = tops.groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "qualified_name"))).alias("t"))  # a few per community
    page = F.concat(F.lit("# "), F.col("community"), F.lit("\n\nSymbols: "), F.col("symbols").cast("string"), F.lit("\n\n"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("- "), x["qualified_name"])), "\n"))
    return sizes.join(lines, "community").select("community", page.alias("value"))


def precision_recall(predicted: DataFrame, actual: DataFrame, group: str, item: str) -> DataFrame:
    """(group, precision, recall, f1) over sets; 0 where nothing is predicted or true."""
    p, a = predicted.select(group, item).distinct().withColumn("p", F.lit(1)), actual.select(group, item).distinct().withColumn("a", F.lit(1))
    g = p.join(a, [group, item], "full").groupBy(group).agg(F.count("p").alias("np"), F.count("a").alias("na"), F.count(F.when(F.col("p").isNotNull() & F.col("a").isNotNull(), 1)).alias("both"))
    pr, rc = F.when(F.col("np") > 0, F.col("both") / F.col("np")).otherwise(0.0), F.when(F.col("na") > 0, F.col("both") / F.col("na")).otherwise(0.0)
    return g.select(group, F.round(pr, 6).alias("precision"), F.round(rc, 6).alias("recall"), F.round(F.when(pr + rc > 0, 2 * pr * rc / (pr + rc)).otherwise(0.0), 6).alias("f1"))


def reciprocal_rank(ranked: DataFrame, right: DataFrame, group: str, item: str, place: str) -> DataFrame:
    """(mrr): mean of one over the place of the first right item, 0 for a group without any."""
    hit = ranked.join(right.select(group, item).distinct(), [group, item], "left_semi").groupBy(group).agg(F.min(place).alias("p"))
    return ranked.select(group).distinct().join(hit, group, "left").agg(F.round(F.avg(F.coalesce(1.0 / F.col("p"), F.lit(0.0))), 6).alias("mrr"))
