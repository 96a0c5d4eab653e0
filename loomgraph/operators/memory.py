"""Session memory: shaping, capture, pairing, sessions, summaries.

Observations are made unique by id first (their earliest arrival). Sessions are uneven: what is ordered within a session is
ordered by a window over the session; caps of a session are features and given as parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TITLE, BODY, LEAST, CAP = 120, 4000, 16, 100


def unique_observations(o: DataFrame) -> DataFrame:
    """One row per id, its earliest arrival."""
    rest = [c for c in o.columns if c != "id"]
    return o.where("id is not null").groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("ingested_at", "created_at")).alias("o")).select("id", *[F.col(f"o.{c}").alias(c) for c in rest])


def title_for(text: Column) -> Column:
    """The first line that is not blank, cut at TITLE characters with an ellipsis."""
    line = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S[^\n]*)$", 1))
    return F.when(F.length(line) > TITLE, F.concat(F.substring(line, 1, TITLE - 1), F.lit("…"))).otherwise(line)


def clip_body(text: Column, limit: int = BODY) -> Column:
    """A text cut at `limit` characters with a marker."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("\n[clipped]"))).otherwise(text)


def shape(o: DataFrame) -> DataFrame:
    """(id, title, body): observations of payloads of enough characters."""
    return o.where(F.length(F.trim("body")) >= LEAST).select("id", title_for(F.col("body")).alias("title"), clip_body(F.col("body")).alias("body"))


def capture(o: DataFrame, cap: int = CAP) -> DataFrame:
    """(id): what is kept of a session: the first of equal bodies of a type, at most `cap` rows of a session in order."""
    first = o.groupBy("session", "doc_type", "body").agg(F.min(F.struct("created_at", "id")).alias("f")).select("session", "f.id", "f.created_at")
    w = Window.partitionBy("session").orderBy("created_at", "id")
    return first.where("session is not null").withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).select("id")


def content_id(*parts: Column) -> Column:
    """A content-addressed id: 16 hex digits of a hash over parts joined by NUL; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def exchanges(o: DataFrame) -> DataFrame:
    """(session, prompt_id, reply_id): each prompt with the last other row before the next prompt of its session."""
    w = Window.partitionBy("session").orderBy("created_at", "id")
    is_prompt = F.lower(F.trim("kind")) == "prompt"
    t = o.where("session is not null").withColumn("turn", F.sum(is_prompt.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("turn > 0")
    g = t.groupBy("session", "turn").agg(F.min_by("id", F.when(is_prompt, F.struct("created_at", "id"))).alias("prompt_id"), F.max_by("id", F.when(~is_prompt, F.struct("created_at", "id"))).alias("reply_id"))
    return g.where("reply_id is not null").select("session", "prompt_id", "reply_id")


def session_stats(o: DataFrame) -> DataFrame:
    """(session, rows, prompts, first_at, last_at, settles_at): a session settles thirty minutes after its last row."""
    g = o.where("session is not null").groupBy("session").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("doc_type") == "prompts", 1)).alias("prompts"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return g.withColumn("settles_at", F.col("last_at") + F.expr("interval 30 minutes"))


def unsummarised(o: DataFrame, least: int = 3, limit: int = 20) -> DataFrame:
    """(session, rows, last_at): sessions of at least `least` rows without a row of kind session, the latest first (a top-k report)."""
    done = o.where("lower(trim(kind)) = 'session'").select("session").distinct()
    g = o.where("session is not null").groupBy("session").agg(F.count(F.lit(1)).alias("rows"), F.max("created_at").alias("last_at")).where(F.col("rows") >= least)
    return g.join(done, "session", "left_anti").orderBy(F.desc("last_at"), "session").limit(limit)


def waiting_sessions(o: DataFrame, now: Column | None = None) -> DataFrame:
    """(session, settles_at): sessions whose last row is less than thirty minutes before `now` (the latest row of all)."""
    s = session_stats(o)
    if now is None:
        s = s.join(F.broadcast(o.agg(F.max("created_at").alias("_now"))))  # a single row
        now = F.col("_now")
    return s.where(F.col("settles_at") > now).select("session", "settles_at")


def pending_summaries(o: DataFrame, least: int = 3, limit: int = 3) -> DataFrame:
    """(session, rows, last_at): the latest settled sessions of at least `least` rows without a summary (a top-k report)."""
    settled = o.where("session is not null").join(waiting_sessions(o).select("session"), "session", "left_anti")
    return unsummarised(settled, least, limit)


def best_logs(o: DataFrame) -> DataFrame:
    """(session, platform_source, replies): of the logs that recorded a session the one with most replies, ties by name."""
    g = o.where("session is not null and lower(trim(kind)) <> 'prompt'").groupBy("session", "platform_source").agg(F.count(F.lit(1)).alias("replies"))
    best = g.groupBy("session").agg(F.min(F.struct((-F.col("replies")).alias("n"), F.col("platform_source").isNotNull().alias("named"), "platform_source")).alias("b"))
    return best.select("session", "b.platform_source", (-F.col("b.n")).alias("replies"))


def recent_documents(o: DataFrame, k: int = 5) -> DataFrame:
    """(session, id, place): the k latest rows of each session, in order of time."""
    w = Window.partitionBy("session").orderBy(F.desc("created_at"), F.desc("id"))
    return o.where("session is not null").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("session", "id", "r")


def memory_filter(o: DataFrame, project: str | None = None, kinds: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of a project, of kinds, within dates; a bare end date includes its day."""
    if project is not None:
        o = o.where(F.col("project") == project)
    if kinds:
        o = o.where(F.lower(F.trim("kind")).isin(kinds))
    if start:
        o = o.where(F.col("created_at") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        limit = F.lit(end).cast("timestamp_ntz")
        o = o.where(F.col("created_at") < limit + F.expr("interval 1 day") if len(end) == 10 else F.col("created_at") <= limit)
    return o


def structural_summary(o: DataFrame) -> DataFrame:
    """(session, summary): every prompt of a session by the title of its text, numbered, in order; sessions without a prompt have none.

    The lines of a session are one text, so they meet in one row; only titles of at most TITLE characters travel."""
    w = Window.partitionBy("session").orderBy("created_at", "id")
    line = title_for(F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("body"), F.lit("")))
    t = o.where("session is not null and lower(trim(kind)) = 'prompt'").select("session", "created_at", "id", line.alias("line")).withColumn("r", F.row_number().over(w))
    lines = F.array_sort(F.collect_list(F.struct("r", F.concat(F.col("r").cast("string"), F.lit(". "), F.col("line")).alias("t"))))
    return t.groupBy("session").agg(lines.alias("ts")).select("session", F.array_join(F.transform("ts", lambda x: x["t"]), "\n").alias("summary"))
