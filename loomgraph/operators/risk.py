"""Risk of changes, dead code, renames, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import rules
from loomgraph.functions.names import below_checkout

# Methods that frameworks call around tests, exempt from test gaps.
LIFECYCLE = "setUp tearDown setUpClass tearDownClass setup_method teardown_method setup teardown __init__ __enter__ __exit__ constructor".split()
# The tools that show what a session is for.
INTENTS = {
    "reviewing": ("detect_changes", "get_review_context", "get_affected_flows", "get_impact_radius"),
    "debugging": ("query_graph", "get_flow", "semantic_search_nodes"),
    "refactoring": ("refactor", "find_dead_code", "suggest_refactorings"),
    "exploring": ("list_communities", "get_architecture_overview", "list_flows", "list_graph_stats"),
}


def churn(edges: DataFrame) -> DataFrame:
    """(file_path, days): days with a change of a file, as the edges' updates show; saturates at 10 in the score."""
    return edges.groupBy("file_path").agg(F.count_distinct(F.to_date("updated_at")).alias("days"))


def risk_scores(n: DataFrame, e: DataFrame, memberships: DataFrame, flows: DataFrame, communities: DataFrame, tests: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """(qualified_name, risk): flows up to .25, callers of other communities up to .15, missing tests .30 to .05, security .20, callers up to .10, churn up to .15."""
    f = n.where("kind in ('Function', 'Test', 'Class')").select("id", "qualified_name", "name", "file_path")
    m = memberships.where("node_id is not null").select("flow_id", "node_id").distinct().join(flows.select(F.col("id").alias("flow_id"), "criticality"), "flow_id").groupBy(F.col("node_id").alias("id")).agg(F.sum("criticality").alias("crit"), F.count(F.lit(1)).alias("flow_n"))
    calls = e.where("kind = 'CALLS' and target_qualified is not null").select(F.col("target_qualified").alias("qualified_name"), "source_qualified")
    callers = calls.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("callers"))
    own = communities.select("qualified_name", F.col("community").alias("own"))
    other = communities.select(F.col("qualified_name").alias("source_qualified"), F.col("community").alias("other"))
    cross = calls.distinct().join(own, "qualified_name").join(other, "source_qualified").where("own <> other").groupBy("qualified_name").agg(F.count(F.lit(1)).alias("cross"))
    t = tests.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("tests"))
    j = f.join(m, "id", "left").join(callers, "qualified_name", "left").join(cross, "qualified_name", "left").join(t, "qualified_name", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    flow = F.when(F.col("crit").isNotNull(), F.least(F.col("crit"), F.lit(0.25))).otherwise(F.least(z("flow_n") * 0.05, F.lit(0.25)))
    score = flow + F.least(z("cross") * 0.05, F.lit(0.15)) + (F.lit(0.30) - F.least(z("tests") / 5.0, F.lit(1.0)) * 0.25) + F.when(rules.security(F.col("name"), F.col("qualified_name")), 0.20).otherwise(0.0) + F.least(z("callers") / 20.0, F.lit(0.10))
    if changes is not None:
        j = j.join(changes, "file_path", "left")
        score = score + F.least(z("days") / 10.0, F.lit(1.0)) * 0.15
    return j.select("qualified_name", F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 4).alias("risk"))


def test_gaps(n: DataFrame, e: DataFrame) -> DataFrame:
    """Functions outside tests without a test of their own; methods that frameworks call around tests aside."""
    tested = e.where("kind = 'TESTED_BY'").select(F.col("source_qualified").alias("qualified_name")).distinct()
    return n.where("kind = 'Function' and not is_test").where(~F.col("name").isin(LIFECYCLE)).join(tested, "qualified_name", "left_anti").select("qualified_name")


def large_functions(n: DataFrame, least: int = 20, limit: int = 20) -> DataFrame:
    """The longest functions, ignored and declaration files aside, with the number of all that match (a top-k report)."""
    lines = F.col("line_end") - F.col("line_start") + 1
    hit = n.where("kind in ('Function', 'Test', 'Class')").where(~rules.ignored(below_checkout(F.col("file_path")))).select("qualified_name", "kind", lines.alias("lines")).where(F.col("lines") >= least)
    total = hit.agg(F.count(F.lit(1)).alias("matching"))
    return hit.orderBy(F.desc("lines"), "qualified_name").limit(limit).join(F.broadcast(total))  # a single row


def type_names(n: DataFrame) -> DataFrame:
    """Names of types in parameters and results."""
    text = F.concat_ws(" ", "params", "return_type")
    return n.where("kind in ('Function', 'Test')").select(F.explode(F.regexp_extract_all(text, F.lit("[A-Z][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()


def dead_code(n: DataFrame, e: DataFrame) -> DataFrame:
    """(qualified_name, kind): functions and classes nobody calls, tests, imports, references or inherits, by full name, by name (a bare or partial target, if the name is unique or the file is imported), or through a member; entry points, dunders, constructors, typed and decorated ones aside."""
    flags = n.where("kind = 'File'").select("file_path", F.col("is_test").alias("test_file"))
    c = n.where("kind in ('Function', 'Class') and not is_test").join(flags, "file_path", "left").where(~F.coalesce("test_file", F.lit(False)))
    c = c.where(~F.col("file_path").rlike(r"\.d\.(ts|mts|cts)$") & ~F.col("name").rlike("^__.*__$") & ~((F.col("name") == "constructor") & F.col("parent_name").isNotNull()))
    c = c.where(~rules.framework_decorator(F.col("extra")) & ~rules.entry_name(F.col("name"), F.col("language")))
    skip = F.exists(rules.decorators(F.col("extra")), lambda d: d.rlike(r"^(property|abstractmethod|classmethod|staticmethod)$|\.abstractmethod$|^HostListener|dataclass"))
    c = c.where(~skip).join(type_names(n).withColumn("typed", F.lit(True)), "name", "left").where(~((F.col("kind") == "Class") & F.coalesce("typed", F.lit(False)))).select("qualified_name", "kind", "name", "file_path")
    direct = e.where("kind in ('CALLS', 'IMPORTS_FROM', 'REFERENCES', 'INHERITS') and target_qualified is not null").select(F.col("target_qualified").alias("qualified_name"))
    direct = direct.unionByName(e.where("kind = 'TESTED_BY' and source_qualified is not null").select(F.col("source_qualified").alias("qualified_name")))
    member = direct.select(F.regexp_extract("qualified_name", r"^(.*::[^.]+)\.[^.]+$", 1).alias("qualified_name")).where("qualified_name <> ''")
    alive = direct.unionByName(member).distinct()
    left = c.join(alive, "qualified_name", "left_anti")
    unique = n.where("kind in ('Function', 'Class') and not is_test").groupBy("name").count().where("count = 1").select("name")
    part = e.where("kind in ('CALLS', 'INHERITS') and target_qualified is not null and target_qualified not like '/%'").select(F.element_at(F.split("target_qualified", "::"), -1).alias("name"), F.col("file_path").alias("edge_file")).distinct()
    imports = e.where("kind = 'IMPORTS_FROM' and target_qualified is not null").select(F.col("file_path").alias("edge_file"), F.substring_index("target_qualified", "::", 1).alias("file_path")).distinct().withColumn("imported", F.lit(True))
    j = left.join(part, "name").join(imports, ["edge_file", "file_path"], "left").join(unique.withColumn("one", F.lit(True)), "name", "left")
    plausible = j.where((F.col("edge_file") == F.col("file_path")) | F.coalesce("imported", F.lit(False)) | F.coalesce("one", F.lit(False))).select("qualified_name").distinct()
    return left.join(plausible, "qualified_name", "left_anti").select("qualified_name", "kind")


def rename_preview(n: DataFrame, e: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file_path, line, why): places that a rename of each name touches: definitions, calls, imports; each place once."""
    defs = n.join(names, "name").select("name", "file_path", F.col("line_start").alias("line"), F.lit("definition").alias("why"), "qualified_name")
    last = F.element_at(F.split("target_qualified", r"::|\."), -1)
    uses = e.where("kind in ('CALLS', 'IMPORTS_FROM', 'REFERENCES') and target_qualified is not null").select(last.alias("name"), "file_path", "line", F.when(F.col("kind") == "IMPORTS_FROM", "import").otherwise("use").alias("why"))
    uses = uses.join(names, "name")
    every = defs.drop("qualified_name").unionByName(uses)
    return every.groupBy("name", "file_path", "line").agg(F.min("why").alias("why"))


def move_suggestions(e: DataFrame, communities: DataFrame) -> DataFrame:
    """(qualified_name, own, target, callers): functions whose callers all lie in one other community."""
    c = communities
    calls = e.where("kind = 'CALLS'").select("source_qualified", F.col("target_qualified").alias("qualified_name")).dropna().distinct()
    j = calls.join(c.select(F.col("qualified_name").alias("source_qualified"), F.col("community").alias("of")), "source_qualified").groupBy("qualified_name").agg(F.min("of").alias("target"), F.max("of").alias("hi"), F.count(F.lit(1)).alias("callers"))
    return j.where("target = hi").join(c.withColumnRenamed("community", "own"), "qualified_name").where("own <> target").select("qualified_name", "own", "target", "callers")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(change, key, n): added and removed keys, with the number of rows."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").select(F.lit("added").alias("change"), key).unionByName(a.join(b, key, "left_anti").select(F.lit("removed").alias("change"), key))


def edge_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(change, key): added and removed edges, nulls compared as equal."""
    a, b = before.select(*key).distinct(), after.select(*key).distinct()
    return b.exceptAll(a).withColumn("change", F.lit("added")).unionByName(a.exceptAll(b).withColumn("change", F.lit("removed")))


def intents(calls: DataFrame, tools: dict[str, Sequence[str]] | None = None, back: int = 10, tool: str = "event_type", session: str = "user_id") -> DataFrame:
    """(event_id, intent): what a session is for at each call: the intent most of its last ten calls show, the first of equal ones; exploring if none does."""
    tools = INTENTS if tools is None else tools
    w = Window.partitionBy(session).orderBy("ts", "event_id").rowsBetween(-(back - 1), 0)
    counts = [F.struct((-F.count(F.when(F.col(tool).isin(*names), 1)).over(w)).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, names) in enumerate(tools.items())]
    best = calls.select("event_id", F.array_min(F.array(*counts)).alias("b"))
    return best.select("event_id", F.when(F.col("b.n") == 0, "exploring").otherwise(F.col("b.k")).alias("intent"))
