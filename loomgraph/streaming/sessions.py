"""Streams: sessions that settle, captured observations, batches of file changes, pending orphans.

Each stream has a batch twin in operators; a stream read to its end gives the same rows, late rows beyond the watermark aside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP, DEBOUNCE, CAP = "30 minutes", "1 second", 100


def settled_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = GAP) -> DataFrame:
    """(key, started, ended, events): sessions that end with a gap; late rows within one gap still count. Works on streams and tables."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", gap)
    g = e.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("events"))
    return g.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def change_batches(changes: DataFrame, ts: str = "ts", debounce: str = DEBOUNCE) -> DataFrame:
    """(path, settled_at, changes): paths whose changes have paused; changes(src, dest, ts), a move counts for both paths."""
    both = changes.select(F.explode(F.array_distinct(F.array_compact(F.array("src", "dest")))).alias("path"), F.col(ts).cast("timestamp").alias("_ts")).withWatermark("_ts", debounce)
    g = both.groupBy(F.session_window("_ts", debounce).alias("w"), "path").agg(F.count(F.lit(1)).alias("changes"))
    return g.select("path", F.col("w.end").alias("settled_at"), "changes")


def capture(observations: DataFrame, cap: int = CAP) -> DataFrame:
    """(session, id): observations kept of a stream: equal bodies of a session once, at most `cap` of a session.

    The state of a session is its hashes of bodies, at most `cap` of them; it goes an hour after the last row."""

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = list(state.get[0]) if state.exists else []
        have, out = set(seen), []
        for b in batches:
            for i, h in b.sort_values(["created_at", "id"])[["id", "h"]].itertuples(index=False):
                if h not in have and len(seen) < cap:
                    have.add(h)
                    seen.append(h)
                    out.append(i)
        state.update((seen,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"session": [key[0]] * len(out), "id": out})

    rows = observations.where("session is not null").select("session", "id", F.col("created_at").cast("timestamp").alias("created_at"), F.xxhash64("doc_type", "body").alias("h"))
    return rows.groupBy("session").applyInPandasWithState(keep, "session string, id string", "seen array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def upsert_batches(key: str, order: str, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that makes each micro-batch unique by key, the latest row first, before it is written."""

    def run(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c != key]
        latest = batch.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")
        write(latest, epoch)

    return run


class OrphanStream:
    """Pending orphans over increments: each micro-batch of edges, nodes, deletions and flow memberships advances the keyed state, which reads the buckets of the keys it touches; a table that brings nothing may be None."""

    def __init__(self) -> None:
        self.state = None

    def __call__(self, edges: DataFrame | None = None, nodes: DataFrame | None = None, tombstones: DataFrame | None = None, external: DataFrame | None = None, memberships: DataFrame | None = None, flows: DataFrame | None = None) -> None:
        from loomgraph.operators.orphans import advance

        self.state = advance(self.state, edges, nodes, tombstones, external, memberships, flows)
