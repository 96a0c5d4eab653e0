"""Operators on text and vectors: brute force, round trips and edge cases."""

import random

import numpy as np
import pytest

from loomgraph.llm import handwritten as H
from loomgraph.llm import mixing, pii, reading, similar, tokens
from loomgraph.llm.queries import OWNERS
from loomgraph.llm.resources import ordinary_words

MODEL = pii.NameModel([f"{g} {f}" for g, f in zip(["Jorethin", "Breluvan", "Delosha", "Quinemi", "Tavodan", "Ildira"] * 4, ["Varnridge", "Skelinger", "Olmovik", "Peñarolt", "Braskessen", "Tullumbra"] * 4)], ordinary_words())


def spans(text):
    return [(k, text[a:b]) for k, a, b in pii.find(text, MODEL)]


@pytest.mark.parametrize("text,want", [
    ("Write to a.b+ci@example.org.", [("email", "a.b+ci@example.org")]),
    ("curl -u x_y (at) post (dot) example (dot) org: /t", [("email", "x_y (at) post (dot) example (dot) org")]),
    ("mail a&#64;b.example, c @ d.test and e AT f DOT test", [("email", "a&#64;b.example"), ("email", "c @ d.test"), ("email", "e AT f DOT test")]),
    ("git@forge.example:team/x.git @retry(max=3) name@domain @scope/x@4.5.1", []),
    ("Call 313.555.0103 (or +44 (0)20 7946 0987) 5 times", [("phone", "313.555.0103"), ("phone", "+44 (0)20 7946 0987")]),
    ("call two zero two five five five zero one two three", [("phone", "two zero two five five five zero one two three")]),
    ("Range 126-145, 192.0.2.21, 1920x1025, 2025-51-0143, Epoch 17171351717", []),
    ("SSN 666-75-6444 and NINO QQ 93 35 59 C", [("id_number", "666-75-6444"), ("id_number", "QQ 93 35 59 C")]),
    ("Steuer-ID 00 344 399 534 must go", [("id_number", "00 344 399 534")]),
    ("at 548 East Candlewick Street now; Pinderweg 24; 9 rue de la Tourbe.", [("address", "548 East Candlewick Street"), ("address", "Pinderweg 24"), ("address", "9 rue de la Tourbe")]),
    ("The 24 Worker Lane tasks; See 26 Parser Road Map items", []),
    ("cc Delosha Varnridge; Skelinger, Tavodan and J. van Olmovik", [("name", "Delosha Varnridge"), ("name", "Skelinger, Tavodan"), ("name", "J. van Olmovik")]),
    ("Sprint Review with Team Lantern, Flow Tracer", []),
    ("", []),
])
def test_find(text, want):
    assert spans(text) == want


def test_spans_map_back_through_disguise():
    text = "​Ｗrite tо аnna@exаmple.org now"
    ((kind, a, b),) = pii.find(text, MODEL)
    assert kind == "email" and text[a:b] == "аnna@exаmple.org"
    spelled = "+ is five five five five five five"
    assert pii.fold(spelled).source(len(pii.fold(spelled).text)) == len(spelled)


def test_redaction_keeps_the_rest():
    t = "x" * 50_000 + " a@b.example, call 313-555-0103.\n" + "y" * 10
    assert pii.redact(t, MODEL) == "x" * 50_000 + " <EMAIL>, call <PHONE>.\n" + "y" * 10
    assert pii.redact(None, MODEL) is None and pii.redact("", MODEL) == ""


def test_find_all_counts_each_id_once(spark):
    rows = [("1", "a@b.example", None, "clash"), ("1", "a@b.example", None, "clash"), (None, "a@b.example", "", "c"), ("2", None, "313-555-0103", "c")]
    got = pii.find_all(spark.createDataFrame(rows, "id string, title string, body string, field string"), MODEL)
    assert sorted(tuple(r)[:4] for r in got.collect()) == [("1", "title", "email", 0), ("2", "body", "phone", 0)]
    assert pii.find_all(spark.createDataFrame([], "id string, title string, body string"), MODEL).count() == 0


def hand(rng, k=14):
    return "\n".join(f"def {rng.choice(['load', 'save', 'walk'])}_{rng.randrange(10**6)}(a{rng.randrange(99)}):\n    return f{rng.randrange(10**6)}(a, {rng.randrange(99)})" for _ in range(k))


def test_evidence():
    rng = random.Random(1)
    code = hand(rng)
    assert H.evidence(None, OWNERS) == "null" and H.evidence(" \n", OWNERS) == "empty" and H.evidence(code, OWNERS) == "plain"
    assert H.evidence("# Copyright Harborline Systems\n" + code, OWNERS) == "own"
    assert H.evidence("// Copyright (c) 2019 The foo Authors.\n" + code, OWNERS) == "foreign"
    assert H.evidence("# Copyright Harborline\n# Code generated by x 1.2. DO NOT EDIT.\n" + code, OWNERS) == "generated"
    assert H.evidence("\n".join(f"X_{i:03} = {i * 7 % 250};" for i in range(50)), OWNERS) == "generated"
    assert H.evidence("var a=b[1],c=!0;" + "function d(e,f){return g(h)||i.j}" * 60, OWNERS) == "minified"
    assert H.evidence('DATA = "' + "aZ09+/" * 200 + '"\n', OWNERS) == "data"
    assert H.evidence(code + '\nSAMPLE = "' + "aZ09+/" * 60 + '"\n' + hand(rng), OWNERS) == "plain"
    assert H.evidence("# TODO: move the generated client out of here once the vendor ships v3\n" + code, OWNERS) == "plain"


def test_attributes_by_precedence():
    rules = [("", "*.pb.go linguist-generated\nvendor/** linguist-vendored\n"), ("vendor/own", "* -linguist-vendored\n"), ("x", "# c\n*.js linguist-generated=false\n")]
    assert H.resolve_attributes("a/b.pb.go", rules) is True
    assert H.resolve_attributes("vendor/lib/c.go", rules) is True
    assert H.resolve_attributes("vendor/own/c.go", rules) is False
    assert H.resolve_attributes("x/a.js", rules) is False and H.resolve_attributes("y/a.js", rules) is None


def test_not_handwritten(spark):
    rng = random.Random(2)
    lib = [hand(rng) for _ in range(4)]
    notice = "# Copyright (c) 2019 The foo Authors.\n"
    rows = [(f"/r{i}/vendor/foo/{j}.py", notice + lib[j]) for i in range(3) for j in range(4)]
    rows += [("/r5/vendor/foo/unmarked.py", hand(rng)), ("/r6/vendor/foo/unread.py", None)]
    rows += [("/r7/core/copy.py", lib[0]), ("/r7/core/changed.py", lib[1] + "\nx = 1\n")]
    own = hand(rng)
    rows += [("/r7/core/own.py", own), ("/r8/core/own_copy.py", own), ("/r7/vendor_portal/a.py", hand(rng)), ("/r8/vendor_portal/b.py", None), ("/r8/empty.py", ""), (None, "x")]
    rows += [("/r9/.gitattributes", "gen/*.py linguist-generated\n"), ("/r9/gen/a.py", hand(rng))]
    df = spark.createDataFrame(rows + rows[:3], "file_path string, content string").selectExpr("*", "1 as shown", "'z' as body")
    got = {r.file_path for r in H.not_handwritten(df, OWNERS).collect()}
    assert got == {f"/r{i}/vendor/foo/{j}.py" for i in range(3) for j in range(4)} | {"/r5/vendor/foo/unmarked.py", "/r6/vendor/foo/unread.py", "/r7/core/copy.py", "/r7/core/changed.py", "/r9/gen/a.py"}
    assert H.not_handwritten(df.limit(0), OWNERS).count() == 0


def brute(vs, k, least):
    names = sorted(vs)
    m = np.array([vs[n] for n in names], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    c, out = np.round(m @ m.T, 12), set()
    for i in range(len(names)):
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-c[i, j], names[j]))[:k]
        out |= {tuple(sorted((names[i], names[j]))) for j in order if c[i, j] >= least}
    return out


def test_similar_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    vs = {}
    for g in range(60):
        c = rng.standard_normal(24)
        for i in range(6):
            vs[f"n{g:02}_{i}"] = (c + 0.15 * rng.standard_normal(24)).astype(np.float32).tolist()
    for i in range(12):
        vs[f"same{i:02}"] = [1.0] * 24  # ties within one class
    rows = [("p", n, v, 1) for n, v in vs.items()] + [("p", "n00_0", vs["n00_0"], 1), ("p", "bad1", None, 1), ("p", "bad2", [], 1), ("p", "bad3", [0.0] * 24, 1), ("p", "bad4", [float("nan")] * 24, 1), ("p", "bad5", [1.0] * 12, 1), ("q", "n00_0", [1.0, 0.0], 1), ("q", "n00_1", [1.0, 0.1], 1), (None, "x", [1.0], 1)]
    df = spark.createDataFrame(rows, "provider string, qualified_name string, vector array<float>, cid int")
    got = {tuple(r) for r in similar.similar_pairs(df).collect()}
    want = {("p", *x) for x in brute(vs, 5, 0.92)} | {("q", "n00_0", "n00_1")}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    assert {x for x in got if "same" in x[1]} == {x for x in want if "same" in x[1]}
    assert similar.similar_pairs(df.limit(0)).count() == 0


def test_encoding(spark):
    rng = random.Random(4)
    words = ["don't", " the", "\n\n  x", "größe", "12345", "!!!", "<|endoftext|>", " ", "日本語", "    "]
    texts = ["", None, "a", "  ", "x" * 9000, " " * 5000 + "y", *["".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(n)) for n in (5, 800, 3000)]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, "b", "c")], "doc_id bigint, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_corpus(df, chunk=500, overlap=120).collect()}
    assert got[None] == tokens.encode("b")
    for i, t in enumerate(texts):
        assert got[i] == tokens.encode(t), i
        assert tokens.decode(got[i]) == (t or "").encode()
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 7, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 5).tolist()) == list(range(n))
    assert mixing.permute(np.arange(1000), 1000, 5).tolist() != mixing.permute(np.arange(1000), 1000, 6).tolist()


def test_mix(spark):
    docs = [(i, "word " * (20 + i % 7), "big" if i % 3 else "small") for i in range(90)] + [(900, None, "big"), (901, "", "big"), (902, "x " * 50, None), (903, "x " * 50, "other"), (0, "word " * 20, "small")]
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("none", 0.2, 3)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    mixture, report = mixing.mix(df, targets, block=32)
    r = {x.source: x for x in report.collect()}
    assert r["none"].tokens_available == 0 and r["none"].tokens_missing > 0 and r["other"].tokens_used == 0
    assert abs(sum(x.actual_share for x in r.values()) - 1) < 1e-9
    rows = mixture.collect()
    used = {}
    for x in rows:
        used[x.source] = used.get(x.source, 0) + x.doc_to - x.doc_from
    assert used == {s: x.tokens_used for s, x in r.items() if x.tokens_used}
    seen = {}
    for x in rows:
        for p in range(x.doc_from, x.doc_to):
            seen[(x.doc_id, p)] = seen.get((x.doc_id, p), 0) + 1
    assert max(v for (d, _), v in seen.items() if d % 3) <= 1 and max(seen.values()) <= 2
    assert mixing.mix(df.limit(0), targets)[0].count() == 0


def test_reading_levels(spark):
    rng = random.Random(5)
    vocab = [[f"{c}{''.join(rng.choice('abcdefgh') for _ in range(5))}" for _ in range(40)] for c in "wxyz"]
    docs, labels = [], []
    for i in range(200):
        lev = i % 4 + 1
        words = [rng.choice(vocab[lev - 1]) if rng.random() < 0.8 else rng.choice(vocab[max(0, lev - 2)]) for _ in range(60)]
        docs.append((i, "the and of " + " ".join(words), "de", 300))
        if i % 3 == 0:
            labels.append((i, lev if rng.random() < 0.9 else max(1, lev - 1), "g"))
    docs += [(500, "der die das und ist nicht ein eine zu mit " * 9, "en", 400), (501, None, "en", None), (502, "the short", "en", 9), (0, docs[0][1], "en", 300)]
    labels += [(0, None, "g"), (None, 3, "g"), (0, 1, "h")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, n_chars bigint")
    lf = spark.createDataFrame(labels, "doc_id bigint, level int, grader string")
    got = {r.doc_id: r.level for r in reading.reading_levels(df, lf).collect()}
    assert set(got) == set(range(200))
    assert sum(got[i] == i % 4 + 1 for i in range(200)) >= 190
    assert {r.level for r in reading.reading_levels(df, lf.limit(0)).collect()} == {2}
    assert reading.reading_levels(df.limit(0), lf).count() == 0


def test_reading_joined_equals_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["a", "b"], 1.0), (2, ["b", "c"], None), (3, ["c", "d"], 4.0), (4, [], None)], "doc_id bigint, words array<string>, grade double")
    a = {r.doc_id: round(r.score, 9) for r in reading.harmonic(docs).collect()}
    monkeypatch.setattr(reading, "MAX_WORDS", 0)
    assert {r.doc_id: round(r.score, 9) for r in reading.harmonic(docs).collect()} == a


def test_similar_over_several_cells_and_regions(spark, monkeypatch):
    monkeypatch.setattr(similar, "REGION_ROWS", 500)
    monkeypatch.setattr(similar, "BLOCK_ROWS", 300)
    monkeypatch.setattr(similar, "QUERY_ROWS", 900)
    monkeypatch.setattr(similar, "CELL_ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    m = centres[rng.integers(0, 60, 2500)] + 0.25 * rng.standard_normal((2500, 16))
    rows = [(f"n{i:04}", [float(x) for x in v], "p") for i, v in enumerate(m.astype(np.float32))]
    df = spark.createDataFrame(rows, "qualified_name string, vector array<float>, provider string")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    asked = list(range(0, 2500, 50))
    queries = spark.createDataFrame([("p", f"n{i:04}") for i in asked], "provider string, name string")
    for floor in (0.92, -1.0):
        want = {(f"n{i:04}", f"n{j:04}") for i in asked for j in np.argsort(-sim[i])[:5] if sim[i, j] >= floor}
        got = {(r["name"], r["other"]) for r in similar.nearest(df, 5, floor, queries=queries).collect()}
        assert len(got) <= 250 and {a for a, _ in got} <= {f"n{i:04}" for i in asked}
        assert len(want & got) >= 0.95 * len(want)


def test_small_sources_are_used_whole(spark):
    docs = [(i, "big", 500) for i in range(40)] + [(100 + i, "tiny", 101) for i in range(4)] + [(None, "tiny", 7), (200, "dust", 600), (0, "big", 500)]
    sizes = spark.createDataFrame(docs, "doc_id bigint, source string, n bigint")
    targets = spark.createDataFrame([("big", 0.89, 1), ("tiny", 0.1, 5), ("dust", 0.001, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix(None, targets, sizes=sizes, shards=3)
    r = {x.source: x for x in report.collect()}
    assert (r["tiny"].tokens_available, r["tiny"].tokens_used, r["tiny"].passes, r["tiny"].tokens_without_id) == (404, 2020, 5.0, 7)
    assert r["dust"].tokens_used == 512 and r["big"].tokens_missing + r["big"].tokens_used <= 20_000
    used, places = {}, set()
    rows = mixture.collect()
    for x in rows:
        used[x.source] = used.get(x.source, 0) + x.doc_to - x.doc_from
        places.add((x.shard, x.slot))
    assert used == {s: x.tokens_used for s, x in r.items()}
    assert len(places) == len({(x.source, x["pass"], x.block) for x in rows}) and {p[0] for p in places} == {0, 1, 2}


def test_precedence_counts_the_depth_of_folders():
    from loomgraph.llm import handwritten as h

    rules = [("", "*.js linguist-generated"), ("a", "*.js -linguist-generated")]
    assert h.resolve_attributes("a/x.js", rules) is False and h.resolve_attributes("a/x.js", rules[::-1]) is False
    assert h.resolve_attributes("b/x.js", rules) is True and h.resolve_attributes("docs/x.md", [("", "docs/** linguist-documentation")]) is None


def test_marks_below_a_long_licence_are_seen():
    from loomgraph.llm import handwritten as h

    line = "// Permission is granted to whom it may concern.\n"
    for n in (2, 17, 60):
        assert h.evidence(line * n + "// Code generated by protoc-gen-go v1.2. DO NOT EDIT.\n" + "func f() {}\n", ()) == "generated"
    block = "/*\n" + " Permission is granted to whom it may concern.\n" * 20 + " Copyright Other Corp\n*/\nint main() { return 0; }\n"
    assert h.evidence(block, ("Harborline",)) == "foreign" and h.evidence(block, ("Other Corp",)) == "own"
