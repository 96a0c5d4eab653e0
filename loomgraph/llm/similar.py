"""Most similar vectors for every vector.

Method: collision-counting hashing. In a collection of some hundred vectors, each of PROJECTIONS random projections is one sorted
array; a query's own projection is the centre of a window in it. Windows are walked outwards: a wider radius (virtual rehashing of
the same arrays) visits only the places that the narrower one did not, and counts of collisions are carried on. A vector that has
collided in THRESHOLD arrays is verified by its exact cosine, once; a query ends when more than k verified vectors lie within its
radius.

One sorted array over all rows would make windows that grow with the collection, so the collection is split first: pivots (a
bounded sample) form regions of about REGION_ROWS vectors; every vector lies in the region of its nearest pivot and asks in its
ROUTES nearest regions. Within a region the first rows are pivots of cells of about CELL_ROWS vectors, each with arrays of its own,
and a query walks its HOME_PROBES nearest cells at home and its PROBES nearest ones elsewhere. A region of more than BLOCK_ROWS vectors is cut into blocks, however many rows fall
into it.

Equal vectors of one provider are one class, whose names are each other's nearest (cosine 1); only its first k + 1 names can
be among the k nearest of anyone, as ties are ordered by name. A class is searched once, so a vector shared by a third of all
rows costs one query.

Defined results: vectors that are null, empty, not of the provider's width (that of most of its vectors), all zero, or hold
NaN or infinity are in no pair; a null name or provider is skipped; rows given twice count once, and of several usable vectors
of one name the least counts; fewer than k others give fewer pairs; empty tables give none; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise

PROJECTIONS, THRESHOLD, SPAN = 16, 5, 0.75
RADII = (0.2, 0.4, 0.8, 1.6)
REGION_ROWS, BLOCK_ROWS, QUERY_ROWS, CELL_ROWS = 16_000, 40_000, 64_000, 200
ROUTES, HOME_PROBES, PROBES = 3, 10, 4
#: Pivots of a provider; beyond MAX_PIVOTS times REGION_ROWS vectors (a thousand million) regions grow and are cut into more blocks.
MAX_PIVOTS = 65_536
#: Values of pivots that are broadcast at once; providers beyond it are searched one group after the other.
BROADCAST_VALUES = 8_000_000
#: Counters of a batch of queries and the vectors of a cell.
WALK = 1_000_000


def usable(rows: DataFrame, name: str = "qualified_name", vector: str = "vector", group: str = "provider") -> DataFrame:
    """(provider, name, v): one usable vector per provider and name."""
    v = F.col(vector)
    fine = rows.select(F.col(group).alias("provider"), F.col(name).alias("name"), v.alias("v")).where("provider is not null and name is not null and v is not null and size(v) > 0")
    fine = fine.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    once = fine.groupBy("provider", "name").agg(F.min("v").alias("v"))
    widths = rows.where(v.isNotNull()).groupBy(F.col(group).alias("provider"), F.size(v).alias("width")).agg(F.count(F.lit(1)).alias("n")).where("width > 0")
    w = Window.partitionBy("provider").orderBy(F.desc("n"), "width")
    width = widths.withColumn("k", F.row_number().over(w)).where("k = 1").select("provider", "width")
    return once.join(F.broadcast(width), "provider").where("size(v) = width").drop("width")


def classes_of(vectors: DataFrame, k: int) -> DataFrame:
    """(provider, c1, c2, v, first_names, cid): vectors that are equal (by a hash of 128 bits), with their first k + 1 names and a number.

    Names are ordered within salts of a class first, so that a class of many rows is never gathered."""
    key = ["provider", "c1", "c2"]
    w = Window.partitionBy(*key, "salt").orderBy("name")
    salted = vectors.withColumn("salt", F.pmod(F.xxhash64("name"), F.lit(64)).cast("int")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    g = salted.groupBy(*key).agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("name")), 1, k + 1).alias("first_names"))  # at most 64 (k + 1) names
    return g.withColumn("cid", F.monotonically_increasing_id())


def _unit(vs: pd.Series) -> np.ndarray:
    m = np.array(vs.tolist(), np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all ranges, one after the other."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - (ends - lens)).astype(np.int32), lens)


class Cell:
    """The sorted arrays of some vectors: PROJECTIONS arrays of places, laid end to end."""

    def __init__(self, base: np.ndarray, directions: np.ndarray):
        p = (base @ directions).T
        order = np.argsort(p, axis=1)
        self.base, self.n = base, len(base)
        self.order, self.values = order.astype(np.int32).ravel(), np.take_along_axis(p, order, axis=1)

    def search(self, queries: np.ndarray, projected: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, cosine) of the verified vectors that may be among the k nearest with a cosine of at least floor."""
        n, m = self.n, len(queries)
        counts = np.zeros(m * n, np.int8)
        last = math.sqrt(max(0.0, 2 - 2 * floor)) if floor > -1 else 2.0
        lo, hi = np.zeros((PROJECTIONS, m), np.int64), np.zeros((PROJECTIONS, m), np.int64)
        live, within = np.arange(m), np.zeros(m, np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first, one = True, np.int8(1)
        for radius in [*[r for r in RADII if r < last], last]:
            limit = max(floor, 1 - radius * radius / 2) - 1e-12
            for j in range(PROJECTIONS):
                c = projected[live, j]
                a, z = np.searchsorted(self.values[j], c - SPAN * radius), np.searchsorted(self.values[j], c + SPAN * radius, side="right")
                if first:
                    starts, lens, rows = a, z - a, live
                else:  # the places on both sides of the narrower window
                    starts, lens, rows = np.concatenate([a, hi[j, live]]), np.concatenate([lo[j, live] - a, z - hi[j, live]]), np.concatenate([live, live])
                # counts of (row, vector) at row * n + vector; ranges of places j * n + start, ...
                at = self.order[_ranges(starts + j * n, lens)]
                at += np.repeat((rows * n).astype(np.int32), lens)
                np.add.at(counts, at, one)
                lo[j, live], hi[j, live] = a, z
            first = False
            found = np.flatnonzero(counts >= THRESHOLD)
            counts[found] = -100  # verified once
            q, b = found // n, found % n
            cos = np.einsum("ij,ij->i", queries[q], self.base[b])
            near = cos >= floor - 1e-12
            held.append((q[near], b[near], cos[near]))
            within = np.zeros(m, np.int64)
            for hq, _, hc in held:
                within += np.bincount(hq[hc >= limit], minlength=m)
            live = live[within[live] <= k]  # the query itself may be among them
            if not len(live):
                break
        return tuple(np.concatenate([h[i] for h in held]) for i in range(3))


def search_block(base: np.ndarray, queries: np.ndarray, k: int, floor: float, probes: np.ndarray | int = PROBES, seed: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, base, cosine) of verified vectors: the base is cut into cells around its first rows, each query walks its nearest ones, `probes` of them."""
    directions = np.random.default_rng(seed).standard_normal((base.shape[1], PROJECTIONS))
    pivots = base[: math.ceil(len(base) / CELL_ROWS)].astype(np.float32)
    home = np.concatenate([np.argmax(base[s : s + 4096].astype(np.float32) @ pivots.T, axis=1) for s in range(0, len(base), 4096)])
    probes = np.minimum(np.broadcast_to(probes, len(queries)), len(pivots))
    n = int(probes.max())
    asks = np.concatenate([np.argsort(-(queries[s : s + 4096].astype(np.float32) @ pivots.T), axis=1)[:, :n] for s in range(0, len(queries), 4096)])
    projected = queries @ directions
    used = np.arange(n)[None, :] < probes[:, None]
    flat, who = asks[used], np.repeat(np.arange(len(queries)), probes)
    by_cell, out = np.argsort(flat, kind="stable"), []
    bounds = np.searchsorted(flat[by_cell], np.arange(len(pivots) + 1))
    for c in range(len(pivots)):
        rows = np.flatnonzero(home == c)
        if not len(rows):
            continue
        cell, q = Cell(base[rows], directions), who[by_cell[bounds[c] : bounds[c + 1]]]
        step = max(1, WALK // len(rows))
        for s in range(0, len(q), step):
            part = q[s : s + step]
            qi, bi, cos = cell.search(queries[part], projected[part], k, floor)
            out.append((part[qi], rows[bi], cos))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([x[i] for x in out]) if out else (none if i < 2 else np.zeros(0)) for i in range(3))


def near_classes(classes: DataFrame, k: int, floor: float, routes: int = ROUTES, queries: DataFrame | None = None) -> DataFrame:
    """(provider, cid, other, cosine): for each class its k nearest other classes among those found, with a cosine of at least floor. Only the classes of `queries` (cid) ask, if given."""
    sizes = {r.provider: (r.n, r.w) for r in classes.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("w")).collect()}  # one row per provider
    groups: list[list[str]] = [[]]
    held = 0
    for p, (n, width) in sorted(sizes.items()):
        values = min(MAX_PIVOTS, math.ceil(n / REGION_ROWS)) * width
        if held and held + values > BROADCAST_VALUES:
            groups.append([])
            held = 0
        groups[-1].append(p)
        held += values
    asking = classes if queries is None else classes.join(queries.select("cid", F.lit(True).alias("asks")), "cid", "left")
    found = None
    for g in groups:
        part = _near(asking.where(F.col("provider").isin(g)), {p: min(MAX_PIVOTS, math.ceil(sizes[p][0] / REGION_ROWS)) for p in g}, k, floor, routes)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("provider", "cid").orderBy(F.desc("cosine"), "other")  # at most k per visited block
    return found.distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def _near(classes: DataFrame, wanted: dict[str, int], k: int, floor: float, routes: int) -> DataFrame:
    pivots: dict[str, np.ndarray] = {}
    for p, want in wanted.items():
        rows = classes.where(F.col("provider") == p).orderBy(F.xxhash64("c1", "c2"), "c1", "c2").limit(want).select("v").toPandas()  # at most MAX_PIVOTS
        pivots[p] = _unit(rows["v"]).astype(np.float32)
    shared = classes.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, g in b.groupby("provider", sort=False):
                piv, m = shared.value[p], _unit(g["v"]).astype(np.float32)
                n = min(routes, len(piv))
                for s in range(0, len(m), 2048):
                    sim = m[s : s + 2048] @ piv.T
                    top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                    best = np.take_along_axis(top, np.argmax(np.take_along_axis(sim, top, 1), axis=1)[:, None], 1)[:, 0]
                    yield pd.DataFrame({"cid": g["cid"].to_numpy()[s : s + 2048], "regions": list(top.astype("int32")), "nearest": best.astype("int32")})

    routed = materialise(classes.select("provider", "cid", "v").mapInPandas(assign, "cid bigint, regions array<int>, nearest int"), "regions")  # numbers only
    asks = F.coalesce("asks", F.lit(False)) if "asks" in classes.columns else F.lit(True)
    rows = classes.select("provider", "cid", "v", asks.alias("asks")).join(routed, "cid")
    placed = rows.select("provider", "cid", "v", "asks", "nearest", F.explode("regions").alias("region")).withColumn("home", F.col("region") == F.col("nearest")).where("home or asks")
    counts = routed.join(classes.select("cid", "provider"), "cid").select("provider", "nearest", F.explode("regions").alias("region"))
    sized = counts.groupBy("provider", "region").agg(F.count(F.when(F.col("region") == F.col("nearest"), 1)).alias("base"), F.count(F.lit(1)).alias("asked"))
    cut = sized.select("provider", "region", F.greatest(F.lit(1), F.ceil(F.col("base") / BLOCK_ROWS)).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERY_ROWS).cast("int").alias("parts"))
    j = placed.join(F.broadcast(cut), ["provider", "region"])  # at most MAX_PIVOTS rows per provider
    h = F.xxhash64("cid", F.lit(3))
    own_block, own_part = F.pmod(h, F.col("blocks")).cast("int"), F.pmod(h, F.col("parts")).cast("int")
    # A row goes once to each (block, part) in which it is a base vector (all parts of its block) or asks (all blocks, its part), or both.
    pairs = F.expr("transform(sequence(0, blocks * parts - 1), x -> struct(x div parts AS block, x % parts AS part))")
    sent = j.withColumn("b", own_block).withColumn("p", own_part).select("provider", "region", "cid", "v", "asks", "home", "b", "p", F.explode(pairs).alias("to"))
    sent = sent.select("provider", "region", F.col("to.block").cast("int").alias("block"), F.col("to.part").cast("int").alias("part"), "cid", "v", (F.col("home") & (F.col("to.block") == F.col("b"))).alias("is_base"), (F.col("asks") & (F.col("to.part") == F.col("p"))).alias("is_query")).where("is_base or is_query")

    def search(g: pd.DataFrame) -> pd.DataFrame:
        base, ask = g["is_base"].to_numpy(), g["is_query"].to_numpy()
        if not base.any() or not ask.any():
            return pd.DataFrame({"provider": [], "cid": [], "other": [], "cosine": []})
        m, ids = _unit(g["v"]), g["cid"].to_numpy()
        qi, bi, c = search_block(m[base], m[ask], k, floor, np.where(base[ask], HOME_PROBES, PROBES))
        r = pd.DataFrame({"provider": g["provider"].iloc[0], "cid": ids[ask][qi], "other": ids[base][bi], "cosine": c})
        r = r[r["cid"] != r["other"]].sort_values(["cid", "cosine", "other"], ascending=[True, False, True])
        return r.groupby("cid", sort=False).head(k)

    return sent.groupBy("provider", "region", "block", "part").applyInPandas(search, "provider string, cid bigint, other bigint, cosine double")


def nearest(rows: DataFrame, k: int = 5, floor: float = -1.0, name: str = "qualified_name", vector: str = "vector", group: str = "provider", routes: int = ROUTES, queries: DataFrame | None = None) -> DataFrame:
    """(provider, name, other, cosine): for each name its k most similar other names, ties in order of name, with a cosine of at least floor. With queries(provider, name) only these names ask; all rows answer."""
    key = ["provider", "c1", "c2"]
    vectors = usable(rows, name, vector, group).withColumns({"c1": F.xxhash64("provider", "v"), "c2": F.xxhash64(F.lit("second"), "v", "provider")})
    vectors = materialise(vectors, "vectors")
    classes = materialise(classes_of(vectors, k), "classes")
    members = vectors.select("name", *key) if queries is None else vectors.select("name", *key).join(queries.select("provider", "name").distinct(), ["provider", "name"], "left_semi")
    numbered = members.join(classes.select(*key, "cid"), key).select("provider", "name", "cid")
    near = near_classes(classes, k, floor, routes, None if queries is None else numbered.select("cid").distinct())
    names = classes.select("provider", F.col("cid").alias("other"), "first_names")
    own = classes.select("provider", "cid", F.col("cid").alias("other"), F.lit(1.0).alias("cosine"), "first_names")
    ranked = near.join(names, ["provider", "other"]).select("provider", "cid", "other", "cosine", "first_names").unionByName(own)
    lists = ranked.groupBy("provider", "cid").agg(F.collect_list(F.struct("cosine", "first_names")).alias("lists"))  # at most k + 1 classes of k + 1 names
    flat = F.flatten(F.transform("lists", lambda x: F.transform(x["first_names"], lambda n: F.struct((-x["cosine"]).alias("d"), n.alias("other"), x["cosine"].alias("cosine")))))
    best = lists.select("provider", "cid", F.slice(F.array_sort(flat), 1, k + 1).alias("best"))
    out = numbered.join(best, ["provider", "cid"]).select("provider", "name", F.explode(F.slice(F.filter("best", lambda x: x["other"] != F.col("name")), 1, k)).alias("b"))
    return out.select("provider", "name", "b.other", "b.cosine")


def similar_pairs(rows: DataFrame, k: int = 5, least: float = 0.92) -> DataFrame:
    """(provider, name_a, name_b), name_a < name_b: at least one is among the other's k most similar, with a cosine of at least `least`."""
    n = nearest(rows, k, least).where(F.col("cosine") >= least)
    return n.select("provider", F.least("name", "other").alias("name_a"), F.greatest("name", "other").alias("name_b")).distinct()
