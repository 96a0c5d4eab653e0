"""Session logs: JSON lines, some of them half written, and logs of a snapshot and patches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, data string, timestamp double"


def json_lines(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Events of JSON-lines files; lines that do not parse (a half-written last line) are left out."""
    raw = spark.read.text(path).select(F.from_json("value", schema).alias("e"), F.col("_metadata.file_path").alias("file"))
    return raw.where("e is not null and coalesce(e.type, e.data) is not null").select("file", "e.*")


def epoch(c: str):
    """Seconds or milliseconds since 1970 as a timestamp."""
    v = F.col(c).cast("double")
    return F.timestamp_micros((F.when(v > 1e11, v / 1000).otherwise(v) * 1_000_000).cast("long"))


def _apply(state, kind: int, keys: list, value):
    """One record of a log: 0 replaces all, 1 sets at a path, 2 appends to the list at a path."""
    if kind == 0:
        return value
    at = state
    for k in keys[:-1]:
        at = at.setdefault(k, {}) if isinstance(at, dict) else at[k]
    last = keys[-1] if keys else None
    if kind == 1 and last is not None:
        if isinstance(at, list) and last == len(at):
            at.append(value)
        else:
            at[last] = value
    elif kind == 2 and last is not None:
        have = at.get(last) if isinstance(at, dict) else at[last]
        at[last] = [*(have or []), *value]
    return state


def replay(records: DataFrame) -> DataFrame:
    """(session, state) of records(session, line_no, value): the JSON a log of a snapshot and patches ends with. Broken lines are skipped; a log is one session and is read in order."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state = None
        for v in pdf.sort_values("line_no")["value"]:
            try:
                r = json.loads(v)
                state = _apply(state, r["kind"], r.get("k", []), r["v"])
            except (ValueError, KeyError, TypeError, IndexError):
                continue
        return pd.DataFrame({"session": [pdf["session"].iloc[0]], "state": [json.dumps(state, sort_keys=True)]})

    return records.groupBy("session").applyInPandas(fold, "session string, state string")
