"""Sources, streams, maintenance and pages."""

import json
from datetime import datetime as D
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import maintain, memory
from loomgraph.serve import pages
from loomgraph.sources import diffs, logs, worktree
from loomgraph.streaming import sessions

DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/x.py
@@ -1,2 +3,4 @@ def f
+a
@@ -9 +20 @@
@@ -30,2 +40,0 @@
--- a/gone.py
+++ /dev/null
@@ -1,3 +0,0 @@"""


def test_diff_ranges(spark):
    rows = [(1, i, x) for i, x in enumerate(DIFF.split("\n"))]
    r = diffs.diff_ranges(spark.createDataFrame(rows, "diff_id int, line_no int, line string")).orderBy("start").collect()
    assert [(x.file_path, x.start, x.end) for x in r] == [("x.py", 3, 6), ("x.py", 20, 20), ("x.py", 40, 40)]


def test_numstat_and_status(spark):
    df = spark.createDataFrame([("1\t2\ta.py",), ("-\t-\tb.bin",), ("3\t0\ta.py",), ("junk",)], "line string")
    assert {(r.file_path, r.commits) for r in diffs.numstat(df).collect()} == {("a.py", 2), ("b.bin", 1)}
    df = spark.createDataFrame([("M\ta.py",), ("R100\told.py\tnew.py",)], "line string")
    assert {r.file_path for r in diffs.name_status(df).collect()} == {"a.py", "old.py", "new.py"}


def test_half_written_log(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"type": "user", "data": "x", "timestamp": 1}\n{"type": "us')
    assert [r.data for r in logs.json_lines(spark, str(tmp_path)).collect()] == ["x"]


def test_replay(spark):
    recs = [{"kind": 0, "v": {"a": [1]}}, {"kind": 1, "k": ["b"], "v": 2}, {"kind": 2, "k": ["a"], "v": [3, 4]}]
    rows = [("s", i, json.dumps(r)) for i, r in enumerate(recs)] + [("s", 9, "{half")]
    r = logs.replay(spark.createDataFrame(rows, "session string, line_no int, value string")).first()
    assert json.loads(r.state) == {"a": [1, 3, 4], "b": 2}


def test_worktree(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / "b.bin").write_bytes(b"\x00\x01")
    got = {r.file_path.split("/")[-1]: r.content for r in worktree.contents(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "x = 1\n", "b.bin": None}
    assert {r.file_path for r in worktree.inventory(spark, str(tmp_path)).collect()} == {"a.py", "b.bin"}


def test_aliases_and_languages(tmp_path):
    (tmp_path / "base.json").write_text('{"compilerOptions": {"paths": {"@x/*": ["x/*"]}}}')
    (tmp_path / "c.json").write_text('{ // comment\n "extends": "./base.json", "compilerOptions": {"paths": {"@x/y/*": ["z/*"],}}}')
    a = worktree.path_aliases(str(tmp_path / "c.json"))
    assert worktree.resolve_alias("@x/y/q", a) == [str(tmp_path / "z" / "q")]
    assert worktree.resolve_alias("@x/q", a) == [str(tmp_path / "x" / "q")]
    assert worktree.custom_languages({"zig": {"extensions": [".zig"]}}) == {"zig": "zig"}
    with pytest.raises(ValueError):
        worktree.custom_languages({"zig": {"extensions": [".py"]}})


def _stream(spark, df, path, f, name, mode="append"):
    df.coalesce(1).write.parquet(path)
    s = f(spark.readStream.schema(df.schema).parquet(path))
    q = s.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_sessions_equal_batch(spark, tmp_path):
    t0 = D(2025, 1, 1)
    rows = [(1, t0 + timedelta(minutes=m)) for m in (0, 10, 39, 80)] + [(2, t0), (9, t0 + timedelta(days=2))]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp")
    batch = {tuple(r) for r in sessions.settled_sessions(df).where("user_id < 9").collect()}
    got = _stream(spark, df, str(tmp_path / "s"), sessions.settled_sessions, "settled")
    assert {tuple(r) for r in got.where("user_id < 9").collect()} == batch and len(batch) == 3


def test_streamed_capture_equals_batch(spark, tmp_path):
    rows = [(f"i{i:03}", "s", "note", f"body {i % 5}" if i % 2 else f"long body {i}", D(2025, 1, 1) + timedelta(seconds=i)) for i in range(60)] + [("x", None, "note", "b", D(2025, 1, 1))]
    df = spark.createDataFrame(rows, "id string, session string, doc_type string, body string, created_at timestamp")
    batch = {r.id for r in memory.capture(df, 10).collect()}
    got = _stream(spark, df, str(tmp_path / "c"), lambda s: sessions.capture(s, 10), "captured")
    assert {r.id for r in got.collect()} == batch and len(batch) == 10


def test_replace_equals_rebuild(spark):
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "file_path string, v int")
    new = spark.createDataFrame([("a", 9), ("c", 4)], "file_path string, v int")
    files = spark.createDataFrame([("a",), ("c",)], "file_path string")
    assert sorted(tuple(r) for r in maintain.replace_files(old, new, files).collect()) == [("a", 9), ("b", 3), ("c", 4)]
    m = maintain.merge_flows(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "entry int, path string"), spark.createDataFrame([(1, "x"), (2, "n"), (4, "q")], "entry int, path string"))
    assert {(r.entry, r.action) for r in m.collect()} == {(1, "keep"), (2, "update"), (3, "delete"), (4, "insert")}


def test_pages(spark):
    df = spark.range(5).withColumn("text", F.lit("x" * 40))
    first = pages.page(df, ["id"], 2, None, "q", {"a": 1}, "v1")
    assert [r["id"] for r in first["data"]] == [0, 1] and first["page"]["has_more"]
    second = pages.page(df, ["id"], 2, first["page"]["next_cursor"], "q", {"a": 1}, "v1")
    assert [r["id"] for r in second["data"]] == [2, 3]
    for args, v in (({"a": 2}, "v1"), ({"a": 1}, "v2")):
        with pytest.raises(pages.CursorError):
            pages.page(df, ["id"], 2, first["page"]["next_cursor"], "q", args, v)
    with pytest.raises(pages.CursorError):
        pages.decode_cursor("!!", "q", "v")
    assert len(pages.page(df, ["id"], 5, None, "q", {}, "v", budget=40)["data"]) == 2


def test_memory_shapes(spark):
    o = spark.createDataFrame([("1", "\n  first line\nsecond"), ("2", "short"), ("3", "y" * 5000), ("4", None)], "id string, body string")
    r = {x.id: x for x in memory.shape(o).collect()}
    assert r["1"].title == "first line" and len(r["3"].title) == 120 and r["3"].body.endswith("[clipped]") and set(r) == {"1", "3"}
