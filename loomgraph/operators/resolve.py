"""Endpoint resolution: names that edges carry are joined to the nodes they mean.

Each resolver is a function of the raw edges: it returns what an endpoint resolves to, never changes an edge in place, and
gives the same again when run on its own result. An endpoint is resolved only if exactly one candidate has evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.names import path_of
from loomgraph.operators.graph import path_suffixes, receiver
from loomgraph.session import materialise

CANDIDATES = 20


def is_bare(c: Column) -> Column:
    """A name without a path."""
    return ~c.contains("::") & ~c.contains("/")


def resolve_bare(n: DataFrame, e: DataFrame, kind: str = "CALLS", endpoint: str = "target_qualified") -> DataFrame:
    """(id, name, status, resolved, candidates, n_candidates): bare endpoints of a kind.

    Evidence for a candidate is that it lies in the file of the edge or in a file which that file imports. One candidate with
    evidence: resolved; several: ambiguous; none, though candidates exist: unresolved; no candidate: unknown. At most
    CANDIDATES candidates are listed, all are counted."""
    edges = e.where((F.col("kind") == kind) & F.col(endpoint).isNotNull() & is_bare(F.col(endpoint))).select("id", F.col(endpoint).alias("name"), "file_path")
    imports = e.where("kind = 'IMPORTS_FROM' and target_qualified is not null").select("file_path", path_of(F.col("target_qualified")).alias("candidate_file")).distinct()
    own = edges.select("file_path").distinct().withColumn("candidate_file", F.col("file_path"))
    seen = imports.unionByName(own).distinct().withColumn("evidence", F.lit(True))
    cands = n.where("kind <> 'File'").select("name", "qualified_name", F.col("file_path").alias("candidate_file"))
    j = edges.join(cands, "name", "left").join(seen, ["file_path", "candidate_file"], "left")
    g = j.groupBy("id", "name").agg(
        F.count("qualified_name").alias("n_candidates"), F.count(F.when(F.col("evidence"), 1)).alias("n_evidence"),
        F.min(F.when(F.col("evidence"), F.col("qualified_name"))).alias("one"), F.slice(F.array_sort(F.collect_set("qualified_name")), 1, CANDIDATES).alias("candidates"),
    )
    status = F.when(F.col("n_evidence") == 1, "resolved").when(F.col("n_evidence") > 1, "ambiguous").when(F.col("n_candidates") > 0, "unresolved").otherwise("unknown")
    return g.select("id", "name", status.alias("status"), F.when(F.col("n_evidence") == 1, F.col("one")).alias("resolved"), "candidates", "n_candidates")


def apply_resolution(e: DataFrame, resolved: DataFrame, endpoint: str = "target_qualified") -> DataFrame:
    """Edges with resolved endpoints; the name as given stays in raw_<endpoint>, so that a run on the result changes nothing."""
    r = resolved.where("resolved is not null").select("id", "resolved")
    raw = F.col(f"raw_{endpoint}") if f"raw_{endpoint}" in e.columns else F.lit(None).cast("string")
    return e.join(r, "id", "left").withColumn(f"raw_{endpoint}", F.coalesce(raw, F.when(F.col("resolved").isNotNull(), F.col(endpoint)))).withColumn(endpoint, F.coalesce("resolved", endpoint)).drop("resolved")


def resolve_scopes(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, resolved): calls of `Scope::name` to the candidate in the innermost scope that encloses the caller."""
    calls = e.where("kind = 'CALLS' and source_qualified like '%::%' and target_qualified like '%::%' and target_qualified not like '/%'").select("id", "source_qualified", "target_qualified")
    inner = F.element_at(F.split("source_qualified", "::", 2), 2)
    parts = F.split(inner, r"\.")
    scopes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct((F.size(parts) - k).alias("depth"), F.array_join(F.slice(parts, 1, F.size(parts) - k - 1), ".").alias("scope")))
    asked = calls.select("id", path_of(F.col("source_qualified")).alias("file"), F.regexp_replace("target_qualified", "::", ".").alias("name"), F.inline(scopes))
    full = F.concat(F.col("file"), F.lit("::"), F.when(F.col("scope") == "", F.col("name")).otherwise(F.concat_ws(".", "scope", "name")))
    hit = asked.withColumn("qualified_name", full).join(n.select("qualified_name"), "qualified_name", "left_semi")
    return hit.groupBy("id").agg(F.max_by("qualified_name", F.struct("depth", "qualified_name")).alias("resolved"))


def resolve_imports(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, status, resolved): imports that name a module, resolved to the only file whose path ends in it."""
    files = n.where("kind = 'File'").select("file_path").distinct()
    imp = e.where("kind = 'IMPORTS_FROM' and target_qualified is not null and target_qualified not like '/%'").select("id", F.regexp_replace("target_qualified", r"\.(py|js|ts|go|rs|rb|java|cs|cpp)$", "").alias("t"))
    imp = imp.select("id", F.regexp_replace(F.regexp_replace("t", r"^\.+/?", ""), r"[.]", "/").alias("module"))
    stem = files.select("file_path", F.explode(path_suffixes(F.regexp_replace("file_path", r"(/__init__)?\.[^./]*$", ""))).alias("module"))
    g = imp.join(stem, "module", "left").groupBy("id").agg(F.count("file_path").alias("n"), F.min("file_path").alias("one"))
    return g.select("id", F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("status"), F.when(F.col("n") == 1, F.col("one")).alias("resolved"))


def resolve_scoped(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, tier, resolved): calls `Class::method` and `Class.method` by tiers: the same file, an imported file, the only one anywhere."""
    calls = e.where("kind = 'CALLS' and target_qualified rlike '^[A-Za-z_][A-Za-z0-9_]*(::|[.])[A-Za-z_][A-Za-z0-9_]*$'").select("id", "file_path", F.split("target_qualified", r"::|\.").alias("p"))
    calls = calls.select("id", "file_path", F.col("p")[0].alias("parent_name"), F.col("p")[1].alias("name"))
    methods = n.where("parent_name is not null").select("parent_name", "name", "qualified_name", F.col("file_path").alias("other"))
    imports = e.where("kind = 'IMPORTS_FROM' and target_qualified is not null").select("file_path", path_of(F.col("target_qualified")).alias("other")).distinct().withColumn("imported", F.lit(True))
    j = calls.join(methods, ["parent_name", "name"]).join(imports, ["file_path", "other"], "left")
    tier = F.when(F.col("file_path") == F.col("other"), 0).when(F.col("imported"), 1).otherwise(2)
    per = j.withColumn("tier", tier).groupBy("id", "tier").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("one"))
    best = per.groupBy("id").agg(F.min(F.struct("tier", "n", "one")).alias("b"))
    return best.where("b.n = 1").select("id", "b.tier", F.col("b.one").alias("resolved"))


def injected_calls(n: DataFrame, e: DataFrame, kind: str = "INJECTS") -> DataFrame:
    """(id, resolved): calls on a receiver whose class is injected: the receiver's type, if it has one implementor, and there the method."""
    impl = e.where("kind in ('IMPLEMENTS', 'INHERITS')").select(F.col("target_qualified").alias("type"), F.col("source_qualified").alias("cls")).distinct()
    inj = e.where(F.col("kind") == kind).select(path_of(F.col("source_qualified")).alias("file"), F.col("target_qualified").alias("type")).distinct()
    of = inj.join(impl, "type", "left").select("file", "type", F.coalesce("cls", "type").alias("cls")).distinct()
    one = of.groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("cls")).where("n = 1")
    calls = e.where("kind = 'CALLS'").select("id", path_of(F.col("source_qualified")).alias("file"), receiver(F.col("extra")).alias("receiver"), F.element_at(F.split("target_qualified", r"[.:]+"), -1).alias("name")).where("receiver is not null")
    m = n.where("parent_name is not null").select("name", "qualified_name", F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("cls"))
    j = calls.join(one, "file").join(m, ["cls", "name"])
    return j.groupBy("id").agg(F.count_distinct("qualified_name").alias("n"), F.min("qualified_name").alias("resolved")).where("n = 1").select("id", "resolved")


def event_calls(e: DataFrame) -> DataFrame:
    """(event, publisher, listener, confidence, tier): every publisher of an event with every listener, as inferred calls.

    The number of pairs of an event is the result itself; both sides are distinct first."""
    pub = e.where("kind = 'PUBLISHES'").select(F.col("target_qualified").alias("event"), F.col("source_qualified").alias("publisher")).dropna().distinct()
    lis = e.where("kind in ('HANDLES', 'CONSUMES')").select(F.col("target_qualified").alias("event"), F.col("source_qualified").alias("listener")).dropna().distinct()
    return pub.join(lis, "event").where("publisher <> listener").select("event", "publisher", "listener", F.lit(0.95).alias("confidence"), F.lit("INFERRED").alias("tier"))


def local_modules(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, resolved): bare references to a symbol of the same directory, if it is the only one there."""
    d = F.regexp_replace("file_path", r"/[^/]*$", "")
    refs = e.where((F.col("kind") == "REFERENCES") & F.col("target_qualified").isNotNull() & is_bare(F.col("target_qualified"))).select("id", d.alias("dir"), F.col("target_qualified").alias("name"))
    here = n.where("kind <> 'File'").select(d.alias("dir"), "name", "qualified_name")
    g = refs.join(here, ["dir", "name"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("resolved"))
    return g.where("n = 1").select("id", "resolved")


def modules_by_stem(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, resolved): imports of a bare module name to the file of that stem in the same checkout, the shortest path first."""
    root = F.substring_index("file_path", "/", 4)
    stem = F.regexp_extract("file_path", r"([^/.]+)\.[^/]*$", 1)
    files = n.where("kind = 'File'").select(root.alias("root"), stem.alias("name"), "file_path")
    imp = e.where((F.col("kind") == "IMPORTS_FROM") & F.col("target_qualified").isNotNull() & is_bare(F.col("target_qualified"))).select("id", root.alias("root"), F.col("target_qualified").alias("name"))
    return imp.join(files, ["root", "name"]).groupBy("id").agg(F.min(F.struct(F.length("file_path").alias("l"), "file_path")).alias("b")).select("id", F.col("b.file_path").alias("resolved"))


def class_index(n: DataFrame) -> DataFrame:
    """(name, qualified_name, file_path) of classes and types."""
    return n.where("kind in ('Class', 'Type')").select("name", "qualified_name", "file_path")


def class_chain(n: DataFrame, e: DataFrame, depth: int = 10) -> DataFrame:
    """(cls, ancestor, depth): ancestors over INHERITS and IMPLEMENTS, at the least depth; cycles end."""
    known = class_index(n).select(F.col("qualified_name").alias("cls"))
    up = materialise(e.where("kind in ('INHERITS', 'IMPLEMENTS') and source_qualified is not null and target_qualified is not null").select(F.col("source_qualified").alias("cls"), F.col("target_qualified").alias("ancestor")).distinct(), "up")
    all_ = level = up.join(known, "cls", "left_semi").withColumn("depth", F.lit(1))
    for k in range(2, depth + 1):
        nxt = level.select("cls", F.col("ancestor").alias("mid")).join(up.select(F.col("cls").alias("mid"), "ancestor"), "mid").select("cls", "ancestor").where("cls <> ancestor").distinct()
        level = materialise(nxt.join(all_.select("cls", "ancestor"), ["cls", "ancestor"], "left_anti").withColumn("depth", F.lit(k)), "chain")
        if level.limit(1).count() == 0:
            break
        all_ = all_.unionByName(level)
    return all_


def supertype_methods(n: DataFrame, e: DataFrame) -> DataFrame:
    """(cls, name, method, depth): methods that a class gets from the nearest ancestor that declares them."""
    m = n.where("kind in ('Function', 'Test') and parent_name is not null").select("name", F.col("qualified_name").alias("method"), F.regexp_replace("qualified_name", r"\.[^.]*$", "").alias("ancestor"))
    j = class_chain(n, e).join(m, "ancestor")
    return j.groupBy("cls", "name").agg(F.min(F.struct("depth", "method")).alias("b")).select("cls", "name", "b.method", "b.depth")


def receiver_admits(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, admits): whether the declared type of a call's receiver may hold the called method: the same class name, or related to it."""
    calls = e.where("kind = 'CALLS'").select("id", "target_qualified", F.get_json_object("extra", "$.receiver_type").alias("type")).where("type is not null")
    m = n.where("parent_name is not null").select(F.col("qualified_name").alias("target_qualified"), "parent_name")
    names = class_chain(n, e).select(F.regexp_extract("cls", r"([^.:/]+)$", 1).alias("a"), F.regexp_extract("ancestor", r"([^.:/]+)$", 1).alias("b"))
    related = names.unionByName(names.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("related", F.lit(True))
    j = calls.join(m, "target_qualified").join(related, (F.col("type") == F.col("a")) & (F.col("parent_name") == F.col("b")), "left")
    return j.select("id", ((F.col("type") == F.col("parent_name")) | F.coalesce("related", F.lit(False))).alias("admits"))


def display_targets(n: DataFrame, e: DataFrame) -> DataFrame:
    """(id, resolved): for display, short names go to a symbol of the same file, else of the same directory, else to the first one."""
    asked = e.where(F.col("target_qualified").isNotNull() & is_bare(F.col("target_qualified"))).select("id", F.col("target_qualified").alias("name"), F.col("file_path").alias("from_file"))
    c = n.where("kind <> 'File'").select("name", "qualified_name", "file_path")
    d = lambda x: F.regexp_replace(x, r"/[^/]*$", "")
    tier = F.when(F.col("file_path") == F.col("from_file"), 0).when(d(F.col("file_path")) == d(F.col("from_file")), 1).otherwise(2)
    return asked.join(c, "name").groupBy("id").agg(F.min(F.struct(tier.alias("tier"), "qualified_name")).alias("b")).select("id", F.col("b.qualified_name").alias("resolved"))
