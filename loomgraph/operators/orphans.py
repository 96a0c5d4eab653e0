"""References to records that do not exist.

A keyed state is maintained over increments. Every table of it is a log whose parts are laid out by bucket of the parent's key, so
that an increment reads the buckets of the keys it touches and appends what it adds; nothing that exists is written again (logs
of many parts are merged now and then). A key is a name of a parent (128-bit hash) or its id. The tables:

* moments: when a parent arrived and when it was deleted, by each of its keys; names outside the store are marked;
* links: which id has which name, so that a deletion by one key is one by the other;
* refs: the references (of edges and of flow memberships) by the key they name; members and flows, by flow, give memberships the
  moment at which they were made;
* pending: changes of the set of references that wait (+1 opened, -1 resolved), by key; their sums are the orphans;
* counts: what each increment opened and resolved, per field and month.

In an increment, new references probe the moments of their keys and wait if the key is missing, deleted, or arrived only after the
reference was made; arriving parents and deletions change what their keys say, and only references to a key that says something
else than before are looked at again: an arrival resolves those that waited, a deletion reopens all made so far. Increments may
come in any order and one large increment gives the same orphans as many small ones.

Before they probe, references are summarised per key, so that a key holding a third of all rows is one row in that join; on the way
back only waiting keys are sent to the references: broadcast below a checked size, else joined with the key salted.

Defined results: null references, and rows without the id that names them, are no references; rows given again count once, with
their earliest moments; an edge id given with several endpoints in one field refers to each of them and counts once if any is an
orphan; a parent whose moments are all null was always there; empty tables give no orphans (of references) or all of them (of
parents). Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.names import name_key
from loomgraph.session import materialise

#: Waiting keys up to this number are broadcast (16 bytes and a moment each, so at most about 25 MB).
BROADCAST_KEYS = 500_000
SALTS = 32
FOREVER = 2**63 - 1
#: Buckets of keys in the layout of a state: an increment of few keys reads few of them.
BUCKETS = 16
#: Parts after which the logs are merged.
MERGE_AFTER = 12
NAME, ID = 0, 1
ARRIVED, DELETED, DELETED_BY_LINK, OUTSIDE = 0, 1, 2, 3
FIELDS = ("source_qualified", "target_qualified", "node_id")
KEY = ["space", "k1", "k2"]


def _us(c: str | Column) -> Column:
    """Microseconds of a timestamp with or without zone (sessions run in UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


@dataclass(frozen=True)
class OrphanState:
    """moments(KEY, at, kind), links(KEY, o1, o2), refs(KEY, field, row_id, made, moment), members(flow_id, node_id), flows(flow_id,
    made), pending(KEY, field, row_id, moment, delta), counts(step, field, period, opened, resolved); all but counts with `bucket`."""

    moments: DataFrame | None = None
    links: DataFrame | None = None
    refs: DataFrame | None = None
    members: DataFrame | None = None
    flows: DataFrame | None = None
    pending: DataFrame | None = None
    counts: DataFrame | None = None
    step: int = 0


def _stack(parts: Iterable[DataFrame | None]) -> DataFrame | None:
    """The union of the parts that are there."""
    out = None
    for p in parts:
        if p is not None:
            out = p if out is None else out.unionByName(p)
    return out


def _part(df: DataFrame, name: str, by: str = "k1") -> DataFrame:
    """Write a part of a log, laid out by bucket; rebalanced, so that the bucket of a heavy key is split over tasks."""
    return materialise(df.withColumn("bucket", F.pmod(by, F.lit(BUCKETS)).cast("int")).hint("rebalance", "bucket"), name, "bucket")


def _of(log: DataFrame, keys: DataFrame, on: list[str], buckets: list[int]) -> DataFrame:
    """The rows of a log that are of some keys; only their buckets are read."""
    return log.where(F.col("bucket").isin(buckets)).join(keys.select(*on).distinct(), on, "left_semi")


def _buckets(keys: DataFrame, by: str = "k1") -> list[int]:
    return [r[0] for r in keys.select(F.pmod(by, F.lit(BUCKETS)).cast("int")).distinct().collect()]  # at most BUCKETS


def _key(space: int, k1: Column | str, k2: Column | str) -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.struct(F.lit(space).cast("byte").alias("space"), col(k1).alias("k1"), col(k2).alias("k2"))


_ZERO = "0L"


def _by_keys(rows: DataFrame, key_id: str, key_name: str, at: str, kind: int) -> DataFrame:
    """(KEY, at, kind): a moment of a record under each of its keys."""
    a, b = name_key(F.col(key_name))
    slim = rows.select(_us(at).alias("at"), a.alias("a"), b.alias("b"), F.col(key_id).cast("long").alias("i")).distinct()
    both = F.inline(F.array(_key(NAME, "a", "b"), _key(ID, "i", F.expr(_ZERO))))
    return slim.select("at", both).where("k1 is not null").select(*KEY, "at", F.lit(kind).alias("kind"))


def link_rows(nodes: DataFrame) -> DataFrame:
    """(KEY, o1, o2): from each key of a record to its other key."""
    a, b = name_key(F.col("qualified_name"))
    once = nodes.where("id is not null and qualified_name is not null").select(F.col("id").cast("long").alias("i"), a.alias("a"), b.alias("b")).distinct()
    row = lambda key, o1, o2: F.struct(key.alias("key"), F.col(o1).alias("o1"), F.expr(o2).alias("o2"))
    both = F.inline(F.array(row(_key(NAME, "a", "b"), "i", _ZERO), row(_key(ID, "i", F.expr(_ZERO)), "a", "b")))
    return once.select(both).select("key.*", "o1", "o2")


def outside_rows(external: DataFrame) -> DataFrame:
    """Moments of names outside the store, which are always present unless the store has them too."""
    a, b = name_key(F.col("qualified_name"))
    rows = external.select(F.lit(NAME).cast("byte").alias("space"), a.alias("k1"), b.alias("k2")).where("k1 is not null")
    return rows.distinct().select(*KEY, F.lit(None).cast("long").alias("at"), F.lit(OUTSIDE).alias("kind"))


def edge_references(edges: DataFrame) -> DataFrame:
    """(KEY, field, row_id, made, moment): one row per delivery and endpoint; made at the arrival of the row."""
    s1, s2 = name_key(F.col("source_qualified"))
    t1, t2 = name_key(F.col("target_qualified"))
    rows = edges.where(F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("row_id"), _us("ingested_at").alias("made"), _us("updated_at").alias("moment"), s1.alias("s1"), s2.alias("s2"), t1.alias("t1"), t2.alias("t2"),
    )
    end = lambda k, a, b: F.struct(_key(NAME, a, b).alias("key"), F.lit(k).cast("byte").alias("field"))
    ends = rows.select("row_id", "made", "moment", F.inline(F.array(end(0, "s1", "s2"), end(1, "t1", "t2"))))
    return ends.select("key.*", "field", "row_id", "made", "moment").where("k1 is not null")


def member_references(members: DataFrame, flows: DataFrame | None, how: str = "left") -> DataFrame:
    """(KEY, field, row_id, made, moment): one row per membership; made when its flow was created, at an unknown moment without one."""
    made = members.withColumn("made", F.lit(None).cast("long")) if flows is None else members.drop("bucket").join(flows.groupBy("flow_id").agg(F.min("made").alias("made")), "flow_id", how)
    return made.select(F.lit(ID).cast("byte").alias("space"), F.col("node_id").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(2).cast("byte").alias("field"), F.col("flow_id").alias("row_id"), "made", F.col("made").alias("moment"))


def facts(moments: DataFrame) -> DataFrame:
    """(KEY, until): references made before `until` are orphans; FOREVER for a deleted parent or one that never was, null for one that is always there."""
    arrived = F.col("kind") == ARRIVED
    own = moments.groupBy(*KEY).agg(
        F.min(F.when(arrived, F.col("at"))).alias("first_seen"), F.max(F.when(arrived, F.col("at"))).alias("last_seen"), F.max(F.when(F.col("kind").isin(DELETED, DELETED_BY_LINK), F.col("at"))).alias("deleted_at"),
        F.max(arrived).alias("own"), F.max(F.col("kind") == OUTSIDE).alias("outside"),
    )
    until = F.when(~F.col("own") & F.col("outside"), F.lit(None)).when(~F.col("own") | (F.col("deleted_at") >= F.col("last_seen")), F.lit(FOREVER)).otherwise(F.col("first_seen"))
    return own.select(*KEY, until.cast("long").alias("until"))


def waiting_keys(refs: DataFrame, until: DataFrame, *more: str) -> DataFrame:
    """Keys with at least one orphan and the moment until which their references are orphans, with further columns of until. References are summarised per key first."""
    asked = refs.groupBy(*KEY).agg(F.min("made").alias("earliest"))
    known = until.withColumn("known", F.lit(True))
    joined = asked.join(known, KEY, "left").withColumn("until", F.when(F.col("known").isNull(), F.lit(FOREVER)).otherwise(F.col("until")))
    return joined.where((F.col("until") > F.col("earliest")) | ((F.col("until") == FOREVER) & F.col("earliest").isNull())).select(*KEY, "until", *more)


def open_references(refs: DataFrame, waiting: DataFrame) -> DataFrame:
    """The references that wait. Broadcast up to BROADCAST_KEYS waiting keys; beyond that the key is salted, so that no key gathers in one task."""
    waiting = materialise(waiting, "waiting")
    if waiting.count() <= BROADCAST_KEYS:
        hit = refs.join(F.broadcast(waiting), KEY)
    else:
        salted = waiting.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = refs.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_merge"), [*KEY, "salt"]).drop("salt")
    return hit.where((F.col("until") > F.col("made")) | (F.col("until") == FOREVER))


def _waits(refs: DataFrame, until: DataFrame) -> DataFrame:
    """(KEY, field, row_id, moment): each reference that is an orphan, once."""
    hit = open_references(refs, waiting_keys(refs, until))
    return hit.groupBy(*KEY, "field", "row_id").agg(F.min("moment").alias("moment"))


def _current(pending: DataFrame) -> DataFrame:
    """What a log of pending changes sums to."""
    return pending.groupBy(*KEY, "field", "row_id").agg(F.sum("delta").alias("n"), F.min("moment").alias("moment")).where("n > 0").drop("n")


def advance(
    state: OrphanState | None, edges: DataFrame | None = None, nodes: DataFrame | None = None, tombstones: DataFrame | None = None, external: DataFrame | None = None,
    memberships: DataFrame | None = None, flows: DataFrame | None = None,
) -> OrphanState:
    """Apply one increment; a table that brings nothing may be None."""
    old = state or OrphanState()
    # Parents: arrivals and deletions under both keys.
    links = _part(link_rows(nodes), "links") if nodes is not None else None
    direct = _by_keys(tombstones, "node_id", "qualified_name", "deleted_at", DELETED) if tombstones is not None else None
    derived = []
    other = lambda x: x.select((F.lit(1) - F.col("space")).cast("byte").alias("space"), F.col("o1").alias("k1"), F.col("o2").alias("k2"), "at", F.lit(DELETED_BY_LINK).alias("kind"))
    if direct is not None:
        direct = materialise(direct, "deletions")
        linked = _stack([links, _of(old.links, direct, KEY, _buckets(direct)) if old.links is not None else None])
        if linked is not None:
            derived.append(other(direct.drop("kind").join(linked, KEY)))
    if links is not None and old.moments is not None:
        before = _of(old.moments.where(F.col("kind") == DELETED), links, KEY, _buckets(links))
        derived.append(other(before.select(*KEY, "at").join(links, KEY)))
    arrivals = _by_keys(nodes, "id", "qualified_name", "ingested_at", ARRIVED) if nodes is not None else None
    new = _stack([arrivals, direct, *derived, outside_rows(external) if external is not None else None])
    moments = _part(new, "moments") if new is not None else None
    # References.
    members = created = None
    came = [edge_references(edges)] if edges is not None else []
    if flows is not None:
        created = _part(flows.where("id is not null").groupBy(F.col("id").cast("long").alias("flow_id")).agg(F.min(_us("created_at")).alias("made")), "flows", "flow_id")
        if old.members is not None:  # memberships that came before their flow
            came.append(member_references(old.members.where(F.col("bucket").isin(_buckets(created, "flow_id"))), created, "inner"))
    if memberships is not None:
        members = _part(memberships.where("flow_id is not null and node_id is not null").select(F.col("flow_id").cast("long").alias("flow_id"), F.col("node_id").cast("long").alias("node_id")).distinct(), "members", "flow_id")
        known = _stack([created, old.flows.where(F.col("bucket").isin(_buckets(members, "flow_id"))) if old.flows is not None else None])
        came.append(member_references(members, known))
    refs = _part(_stack(came), "refs") if came else None
    # What waits now that did not, and the other way round.
    if old.moments is None and old.refs is None:
        delta = _waits(refs, facts(moments)).withColumn("delta", F.lit(1)) if refs is not None and moments is not None else None
        if refs is not None and moments is None:
            delta = refs.groupBy(*KEY, "field", "row_id").agg(F.min("moment").alias("moment")).withColumn("delta", F.lit(1))
    else:
        delta = _changes(old, moments, refs)
    pending = _part(delta, "pending") if delta is not None else None
    counts = materialise(_count(pending, old.step), "counts") if pending is not None else None
    out = OrphanState(
        _stack([old.moments, moments]), _stack([old.links, links]), _stack([old.refs, refs]), _stack([old.members, members]), _stack([old.flows, created]), _stack([old.pending, pending]), _stack([old.counts, counts]), old.step + 1,
    )
    return merged(out) if out.step % MERGE_AFTER == 0 else out


def _changes(old: OrphanState, moments: DataFrame | None, refs: DataFrame | None) -> DataFrame:
    """(KEY, field, row_id, moment, delta) of an increment upon a state: reads the buckets of the keys it touches."""
    touched = materialise(_stack([x.select(*KEY).distinct() for x in (moments, refs) if x is not None]).distinct(), "touched")
    at = _buckets(touched)
    past = _of(old.moments, touched, KEY, at).drop("bucket") if old.moments is not None else None
    now = facts(_stack([past, moments.drop("bucket") if moments is not None else None]))
    was = facts(past) if past is not None else None
    said = lambda f, c: f.select(*KEY, F.col("until").alias(c), F.lit(True).alias(f"has_{c}"))
    both = said(now, "b") if was is None else said(now, "b").join(said(was, "a"), KEY, "left")
    if was is None:
        both = both.withColumn("a", F.lit(None).cast("long")).withColumn("has_a", F.lit(None).cast("boolean"))
    before = F.when(F.col("has_a"), F.col("a")).otherwise(F.lit(FOREVER))
    changed = materialise(both.where(~before.eqNullSafe(F.col("b"))).select(*KEY), "changed")
    again = _of(old.refs, changed, KEY, _buckets(changed)).drop("bucket") if old.refs is not None else None
    asked = _stack([refs.drop("bucket") if refs is not None else None, again])
    now_waits = materialise(_waits(asked, now), "waits") if asked is not None else None
    waited = _current(_of(old.pending, touched, KEY, at)) if old.pending is not None else None
    row = [*KEY, "field", "row_id"]
    if waited is None:
        return now_waits.withColumn("delta", F.lit(1))
    waited = materialise(waited, "waited")
    gone = waited.join(changed, KEY, "left_semi")
    if now_waits is None:
        return gone.withColumn("delta", F.lit(-1))
    both = now_waits.join(waited.select(*row, F.col("moment").alias("past"), F.lit(True).alias("known")), row, "left")
    moment = F.least("moment", "past")  # a row given again may come with an earlier moment, a membership with that of its flow
    moved = F.col("known") & ~moment.eqNullSafe(F.col("past"))
    change = lambda m, d: F.struct(m.alias("moment"), F.lit(d).alias("delta"))
    opened = F.when(F.col("known").isNull(), F.array(change(F.col("moment"), 1))).when(moved, F.array(change(moment, 1), change(F.col("past"), -1)))
    return both.select(*row, F.inline(opened)).unionByName(gone.join(now_waits.select(*row), row, "left_anti").withColumn("delta", F.lit(-1)))


def merged(state: OrphanState) -> OrphanState:
    """The same state with each log in one part."""
    s = state
    once = lambda log, name, by="k1": _part(log.drop("bucket").distinct(), name, by) if log is not None else None
    refs = _part(s.refs.groupBy(*KEY, "field", "row_id").agg(F.min("made").alias("made"), F.min("moment").alias("moment")), "refs") if s.refs is not None else None
    pending = _part(_current(s.pending).withColumn("delta", F.lit(1)), "pending") if s.pending is not None else None
    return replace(s, moments=once(s.moments, "moments"), links=once(s.links, "links"), refs=refs, members=once(s.members, "members", "flow_id"), flows=once(s.flows, "flows", "flow_id"), pending=pending, counts=materialise(s.counts, "counts") if s.counts is not None else None)


def _month(us: str) -> Column:
    return F.date_format(F.timestamp_micros(F.col(us)), "yyyy-MM")


def _field(c: str = "field") -> Column:
    return F.array(*map(F.lit, FIELDS))[F.col(c).cast("int")]


def _count(changes: DataFrame, step: int) -> DataFrame:
    g = changes.groupBy("field", _month("moment").alias("period"))
    return g.agg(F.count(F.when(F.col("delta") > 0, 1)).alias("opened"), F.count(F.when(F.col("delta") < 0, 1)).alias("resolved")).select(F.lit(step).alias("step"), _field().alias("ref_field"), "period", "opened", "resolved")


def orphans(state: OrphanState, memberships: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """(ref_table, ref_field, period, row_key): every reference that is an orphan in this state, read from what it keeps pending. Memberships and flows given here are applied as a last increment."""
    if memberships is not None or flows is not None:
        state = advance(state, memberships=memberships, flows=flows)
    member = F.col("field") == 2
    key = F.when(member, F.concat_ws(":", F.col("row_id"), F.col("k1"))).otherwise(F.col("row_id").cast("string"))
    rows = _current(state.pending).select("field", key.alias("row_key"), "moment").groupBy("field", "row_key").agg(F.min("moment").alias("moment"))
    return rows.select(F.when(member, "flow_memberships").otherwise("edges").alias("ref_table"), _field().alias("ref_field"), _month("moment").alias("period"), "row_key")


def orphan_counts(state: OrphanState) -> DataFrame:
    """(ref_table, ref_field, period, orphans): what waits, per table, field and period, from the counts that the increments kept."""
    g = state.counts.groupBy("ref_field", "period").agg((F.sum("opened") - F.sum("resolved")).alias("orphans")).where("orphans <> 0")
    return g.select(F.when(F.col("ref_field") == "node_id", "flow_memberships").otherwise("edges").alias("ref_table"), "ref_field", "period", "orphans")


def absences(moments: DataFrame) -> DataFrame:
    """(KEY, since, until): each time a known parent is absent: from the start (since is null) to its arrival, and from each deletion
    to the next arrival, else FOREVER. A deletion at the moment of an arrival wins. until is null for names outside the store and
    for parents without a moment: these are always present."""
    own = moments.groupBy(*KEY).agg(F.max(F.col("kind") == ARRIVED).alias("own"), F.max((F.col("kind") == ARRIVED) & F.col("at").isNotNull()).alias("dated"), F.max(F.col("kind") == OUTSIDE).alias("outside"))
    gone = F.max(F.col("kind") != ARRIVED).alias("gone")
    dated = moments.where(F.col("at").isNotNull() & (F.col("kind") != OUTSIDE)).groupBy(*KEY, "at").agg(gone).join(own.where("dated").select(*KEY), KEY, "left_semi")
    w = Window.partitionBy(*KEY).orderBy("at")  # the moments of one parent
    first = F.col("before").isNull()
    flips = dated.withColumn("before", F.lag("gone").over(w)).where(first | (F.col("before") != F.col("gone")))
    gaps = flips.withColumn("next", F.lead("at").over(w)).where(first | F.col("gone"))
    out = gaps.select(*KEY, F.when(~first, F.col("at")).alias("since"), F.when(first & ~F.col("gone"), F.col("at")).otherwise(F.coalesce("next", F.lit(FOREVER))).alias("until"))
    never = F.lit(None).cast("long")
    return out.unionByName(own.where("(own and not dated) or (outside and not own)").select(*KEY, never.alias("since"), never.alias("until")))


def waiting_snapshots(state: OrphanState) -> DataFrame:
    """(period, ref_field, opened, reopened, resolved, waiting): in each month, how many references of edges and flow memberships
    opened, how many of these were reopened by the deletion of their parent, how many were resolved by a parent that arrived, and
    how many wait at its end. A reference opens when made while its parent is absent, and whenever its parent is deleted; one
    made at an unknown moment counts in the period null if its parent is absent at last. Per-key sums are made before anything
    is shuffled by month."""
    gaps = materialise(absences(state.moments.drop("bucket")), "absences")
    hits = open_references(state.refs.drop("bucket"), waiting_keys(state.refs, gaps, "since"))
    once = hits.groupBy(*KEY, "field", "row_id", "since", "until").agg(F.min("made").alias("made"))  # rows given again
    period = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM").alias("period")
    count = lambda c, name: F.coalesce(c, F.lit(False)).cast("int").alias(name)
    start = F.when(F.col("made").isNotNull(), F.greatest("made", "since"))
    no, yes = F.lit(False), F.lit(True)
    events = F.array(
        F.struct(period(start), count(yes, "opened"), count(F.col("since") > F.col("made"), "reopened"), count(no, "resolved")),
        F.struct(period(F.col("until")), count(no, "opened"), count(no, "reopened"), count(F.col("until") < FOREVER, "resolved")),
    )
    per = once.select(_field().alias("ref_field"), F.inline(events)).where("opened + resolved > 0").groupBy("ref_field", "period").agg(*[F.sum(c).alias(c) for c in ("opened", "reopened", "resolved")])
    w = Window.partitionBy("ref_field").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)  # a row per month
    return per.withColumn("waiting", F.sum(F.col("opened") - F.col("resolved")).over(w))
