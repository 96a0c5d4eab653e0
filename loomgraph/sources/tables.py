"""Reading the store's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the store; only the columns a query names are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
