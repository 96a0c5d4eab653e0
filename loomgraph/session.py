"""Session settings and the shared folder that cuts lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(app: str = "loomgraph", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, else one set here (local runs only)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(shared_dir, "own", None)
        if not at:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            at = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
    return at


def materialise(df: DataFrame, name: str = "step", by: str | None = None) -> DataFrame:
    """Write df once into the shared folder, in folders by a column if one is given, and read it back.

    It cuts the lineage, survives the loss of executors, and is computed once (checkpoint() computes its last stage twice).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomgraph/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised() -> None:
    """Delete what materialise() wrote in this process; results that still read it must be consumed before."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may already be gone
            return


atexit.register(drop_materialised)
