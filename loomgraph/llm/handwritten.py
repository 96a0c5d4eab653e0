"""Source files nobody of the project wrote by hand: generated, minified, vendored, or data stored as code.

Method: attribute files are parsed and their globs resolved with the precedence of directories (deeper files and later lines
win); what they declare holds. Files of undeclared repositories are judged by equivalent patterns mined from all files: a
directory (or pair of directories) or a shape of file names is a pattern if most files under it, in several places, are declared by
attribute files or, where these say nothing and the file is readable, show evidence in their own text: a tool's marker, the notice
of another owner, minified lines, tables of numbered declarations, or mostly literal data. Unmarked copies outside such directories are found by shingles of five words: bodies
that equal, or reach a similarity of 0.8 with, a body of another owner.

The text of a file counts without its leading comment, so that a dropped or added notice changes nothing. Copies within the
project have no foreign body in their group and stay. Content that could not be read (null) is judged by path alone.

Defined results: null paths are skipped; empty contents show no evidence; a path given twice counts once, with the evidence of
all its rows; an empty table gives no rows; further columns are ignored; contents are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import materialise

MIN_SHARE, MIN_NOTICES, MIN_FILES, MIN_PLACES = 0.7, 0.5, 3, 2
SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
SALTS = 8

# What tools write into the head of their output.
TOOL_MARK = re.compile(
    r"""@generated\b|<auto-?generated|\bauto-?(?:matically[ ])?generated\b(?=[ ]+(?:by|from|file|code)|\W*$)|\bcode[ ]generated\b
    |\b(?:generated|produced|created|emitted)[ ](?:automatically[ ])?(?:by|with|from|using)[ ](?:the[ ])?[\w ]*?(?:generator|compiler|tool|script|\w+[ ]v?\d+\.\d)
    |\bmachine-(?:written|generated)\b|\bdo[ ]not[ ](?:edit|modify|change)\b|\bnot[ ]meant[ ]to[ ]be[ ]edited\b|\boverwritten[ ](?:on|by|at)\b|\bchanges?[ ](?:here[ ])?will[ ]be[ ](?:lost|overwritten)
    |\bnicht[ ]von[ ]hand\b|\bautomatisch[ ](?:erzeugt|generiert)|\bfichier[ ](?:produit|généré)|\bne[ ]pas[ ]modifier\b|\bgenerado[ ](?:automáticamente|por)\b|\bno[ ](?:editar|modificar)\b""",
    re.X | re.I | re.M,
)
OWNER_MARK = re.compile(
    r"""(?:copyright|\(c\)|©)[^\n]{0,160}|SPDX-(?:License-Identifier|FileCopyrightText)[^\n]*|\b(?:imported|vendored|copied|forked|taken)[ ]from[ ][\w.@/\-]+[ ](?:release|version|v?\d)[^\n]*
    |\bverbatim[ ]copy[ ]of\b[^\n]*|\bpart[ ]of[ ]the[ ][\w.\-]+[ ](?:distribution|project|library|package)\b[^\n]*|\breport[ ](?:problems|bugs|issues)[ ]upstream\b""",
    re.X | re.I,
)
_COMMENT = re.compile(r"^\s*(?://|/\*|\*|--|<!--|;|%|#(?!include|define|if|endif|pragma|import))")
_BLOCK = re.compile(r"^\s*(/\*|<!--)")
_CLOSING = {"/*": "*/", "<!--": "-->"}
_STRING = re.compile(r'"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'')
_NUMBERS = re.compile(r"\d+")
_WORDS = re.compile(r"\w+")


def head_end(lines: Sequence[str]) -> int:
    """The number of lines of the comment, however long, with which a file begins; blank lines belong to it, and so does all of a block comment."""
    closing = None
    for k, line in enumerate(lines):
        if closing:
            if closing in line:
                closing = None
        elif line.strip() and not _COMMENT.match(line):
            return k
        else:
            m = _BLOCK.match(line)
            if m and _CLOSING[m.group(1)] not in line[m.end() :]:
                closing = _CLOSING[m.group(1)]
    return len(lines)


def head_of(text: str) -> str:
    """The comment at the top of a file."""
    lines = text.split("\n")
    return "\n".join(lines[: head_end(lines)])


def body_words(text: str) -> list[str]:
    """The words of a file after its leading comment."""
    lines = text.split("\n")
    return _WORDS.findall("\n".join(lines[head_end(lines) :]))


def foreign_notice(head: str, owners: Sequence[str]) -> tuple[bool, bool]:
    """(a notice of another owner, a notice of one of `owners`) in the head of a file."""
    own = any(o.lower() in head.lower() for o in owners)
    other = any(not any(o.lower() in m.group().lower() for o in owners) for m in OWNER_MARK.finditer(head))
    return other and not own, own


def repetition(text: str) -> float:
    """Share of lines that belong to a shape (numbers and strings aside) which holds numbers and comes at least six times with rising first numbers."""
    shapes: Counter[str] = Counter()
    firsts: dict[str, list[int]] = {}
    n = 0
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        n += 1
        k = _NUMBERS.search(s)
        if k:
            shape = _NUMBERS.sub("0", _STRING.sub("S", s))
            shapes[shape] += 1
            firsts.setdefault(shape, []).append(int(k.group()[:18]))
    if not n:
        return 0.0
    return sum(c for s, c in shapes.items() if c >= 6 and sum(b > a for a, b in zip(firsts[s], firsts[s][1:])) >= 0.8 * (c - 1)) / n


def evidence(text: str | None, owners: Sequence[str]) -> str:
    """What a file's own text shows: null, empty, foreign, generated, minified, data, own or plain."""
    if text is None:
        return "null"
    if not text.strip():
        return "empty"
    head = head_of(text)
    foreign, own = foreign_notice(head, owners)
    if TOOL_MARK.search(head):
        return "generated"
    if foreign:
        return "foreign"
    solid = len(re.sub(r"\s", "", text))
    bare = _STRING.sub("", text)
    bare_solid = re.sub(r"\s", "", bare)
    longest = max(map(len, bare.split("\n")))
    if longest >= 200 and longest >= 0.5 * len(bare):
        letters = sum(c.isalpha() for c in bare)
        return "minified" if letters >= 0.3 * len(bare_solid) and not re.match(r"[\[{(\d\s,.:\]})-]+$", bare) else "data"
    words = _WORDS.findall(bare)
    if len(bare) >= 300 and len(bare_solid) >= 0.88 * len(bare) and sum(len(w) <= 2 for w in words) >= 0.5 * len(words):
        return "minified"  # wrapped at some width
    if repetition(text) >= 0.6:
        return "generated"
    if len(bare_solid) <= 0.3 * solid and solid >= 200:
        return "data"
    if solid >= 200 and sum(w[0].isdigit() for w in words) >= 0.8 * len(words):
        return "data"
    values = sum(c.isdigit() or c in "[]{}(),.:-+\"'" for c in re.sub(r"\s", "", text))
    if values >= 0.75 * solid and solid >= 200:
        return "data"
    return "own" if own else "plain"


_HEX = re.compile(r"\.[0-9a-f]{6,40}(?=\.)")


def name_shapes(name: str) -> list[str]:
    """Shapes of a file name that tools leave: its chain of extensions, and the first and last parts of its stem."""
    name = _HEX.sub(".#", name)
    stem, dot, chain = name.partition(".")
    ext = "." + name.rpartition(".")[2] if dot else ""
    out = []
    if "." in chain:
        out.append(f"*.{chain}")
    parts = [p for p in re.split(r"_|-", stem)]
    if len(parts) > 1 and parts[-1]:
        out.append(f"*_{parts[-1]}{ext}")
        out.append(f"{parts[0]}_*{ext}" if parts[0] else f"_*_{parts[-1]}{ext}")
        if len(parts) > 2 and parts[0]:
            out += [f"{parts[0]}_*_{parts[-1]}{ext}", f"*_{parts[-2]}_{parts[-1]}{ext}"]
    camel = re.search(r"(?<=[a-z0-9])([A-Z][A-Za-z_]+)$", stem)
    if camel:
        out.append(f"*{camel.group(1)}{ext}")
    return out


def path_patterns(path: str) -> list[tuple[str, str]]:
    """(pattern, place) of a path: its directories, pairs of directories and name shapes, each with the place where it stands."""
    parts = path.replace("\\", "/").strip("/").split("/")
    dirs, out = parts[:-1], []
    for i, p in enumerate(dirs):
        place = "/".join(dirs[:i])
        out.append((f"d:{p}", place))
        if i:
            out.append((f"p:{dirs[i - 1]}/{p}", "/".join(dirs[: i - 1])))
    out += [(f"n:{s}", "/".join(dirs)) for s in name_shapes(parts[-1])]
    return out


# Attribute files


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(glob, attribute, value) of the lines of an attribute file that mark generated or vendored paths; None for unspecified."""
    out = []
    for line in text.splitlines():
        fields = line.strip().split()
        if not fields or fields[0].startswith("#"):
            continue
        for a in fields[1:]:
            m = re.fullmatch(r"(-|!)?(linguist-(?:generated|vendored))(?:=(\w+))?", a)
            if m:
                value = None if m.group(1) == "!" else m.group(1) != "-" and (m.group(3) or "true").lower() not in ("false", "0", "unset")
                out.append((fields[0], m.group(2), value))
    return out


def glob_regex(glob: str) -> str:
    """A regular expression for an attribute glob, against the path below the attribute file's directory."""
    anchored = "/" in glob.rstrip("/")
    g = glob.lstrip("/")
    out, i = "", 0
    while i < len(g):
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif g.startswith("**", i):
            out, i = out + ".*", i + 2
        elif g[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif g[i] == "?":
            out, i = out + "[^/]", i + 1
        elif g[i] == "[" and "]" in g[i + 2 :]:
            j = g.index("]", i + 2)
            out, i = out + "[" + g[i + 1 : j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(g[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out + r"\Z"


def resolve_attributes(path: str, rules: Sequence[tuple[str, str]]) -> bool | None:
    """What attribute files (directory, text) along a path declare: the deepest directory wins, there the last matching line."""
    state: dict[str, bool | None] = {}
    for folder, text in sorted(rules, key=lambda r: (len([x for x in r[0].split("/") if x]), r[0])):  # the root is 0 deep
        below = path[len(folder) :].lstrip("/") if path.startswith(folder.rstrip("/") + "/") or not folder else None
        if below is None:
            continue
        for glob, attribute, value in parse_attributes(text):
            if re.match(glob_regex(glob), below):
                state[attribute] = value
    values = [v for a, v in state.items() if v is not None]
    return True if any(values) else False if values else None


def declared(files: DataFrame) -> DataFrame:
    """(file_path, declared): paths that attribute files of their directory or one above mark, or unmark."""
    rules = files.where(F.col("file_path").rlike(r"(^|/)\.gitattributes$") & F.col("content").isNotNull()).select(F.regexp_replace("file_path", r"/?\.gitattributes$", "").alias("folder"), "content").distinct()
    paths = files.where("file_path is not null").select("file_path").distinct()
    depth = F.size(F.split("file_path", "/"))
    above = paths.withColumn("folder", F.explode(F.transform(F.sequence(F.lit(0), depth - 1), lambda k: F.array_join(F.slice(F.split("file_path", "/"), 1, k), "/"))))
    found = above.join(rules, "folder").groupBy("file_path").agg(F.collect_list(F.struct("folder", "content")).alias("rules"))  # one per directory of the path

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = [resolve_attributes(p, [(r["folder"], r["content"]) for r in rs]) for p, rs in zip(b["file_path"], b["rules"])]
            yield pd.DataFrame({"file_path": b["file_path"], "declared": pd.Series(v, dtype="boolean")})

    return found.mapInPandas(judge, "file_path string, declared boolean").where("declared is not null")


# Bodies


_A = np.random.default_rng(11).integers(1, 2**61 - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = np.random.default_rng(12).integers(0, 2**61 - 1, BANDS * ROWS, dtype=np.uint64)


def shingles(words: Sequence[str]) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words; of all words for a shorter body."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest("\x00".join(words))], np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    n, out = len(h) - SHINGLE + 1, np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29)))
    return np.unique(out)


def band_keys(s: np.ndarray) -> list[int]:
    """One key per band of min-hashes."""
    m = (s[None, :] * _A[:, None] + _B[:, None]).min(axis=1)
    return [int(np.int64(np.uint64(xxhash.xxh64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i)))) for i in range(BANDS)]


def inspect(files: DataFrame, owners: Sequence[str]) -> DataFrame:
    """(file_path, shown, body, shingles, bands) of each row; the last three for readable prose of code only."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["file_path"], b["content"]):
                shown = evidence(text if isinstance(text, str) else None, owners)
                body, sh, bands = None, None, None
                if shown in ("plain", "foreign"):
                    s = shingles(body_words(text))
                    if len(s):
                        body, sh, bands = xxhash.xxh128_hexdigest(s.tobytes()), s.view(np.int64), band_keys(s)
                out.append((path, shown, body, sh, bands))
            yield pd.DataFrame(out, columns=["file_path", "shown", "body", "shingles", "bands"])

    return files.where("file_path is not null").select("file_path", "content").mapInPandas(look, "file_path string, shown string, body string, shingles array<bigint>, bands array<bigint>")


def mine_patterns(seen: DataFrame, said: DataFrame) -> DataFrame:
    """Paths under mined patterns; counts are over all files. said(file_path, declared): what attribute files declare counts before what a text shows.

    A file that cannot be read is judged by any pattern most of whose readable files show evidence. A readable file that shows
    none (it would show a tool's work itself) is judged by directories most of whose files carry another owner's notice.
    """

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(pat, place, p, s) for p, s in zip(b["file_path"], b["shown"]) for pat, place in dict(path_patterns(p)).items()]
            yield pd.DataFrame(out, columns=["pattern", "place", "file_path", "shown"])

    told = seen.select("file_path", "shown").join(said, "file_path", "left")
    told = told.select("file_path", F.when(F.col("declared"), "declared").when(~F.col("declared"), "kept").otherwise(F.col("shown")).alias("shown"))
    rows = told.mapInPandas(explode, "pattern string, place string, file_path string, shown string")
    hit = F.col("shown").isin("declared", "foreign", "generated", "minified", "data").cast("long")
    notice = (F.col("shown") == "foreign").cast("long")
    unread = F.col("shown").isin("null", "empty")
    by_place = rows.groupBy("pattern", "place").agg(F.sum(hit).alias("hits"), F.sum(notice).alias("notices"), F.sum((~unread).cast("long")).alias("files"))
    per = by_place.groupBy("pattern").agg(*[F.sum(c).alias(c) for c in ("hits", "notices", "files")], F.sum((F.col("hits") > 0).cast("long")).alias("places"), F.sum((F.col("notices") > 0).cast("long")).alias("notice_places"))
    tool = (F.col("places") >= MIN_PLACES) & (F.col("hits") >= MIN_SHARE * F.col("files"))
    copied = (F.col("notice_places") >= MIN_PLACES) & (F.col("notices") >= MIN_NOTICES * F.col("files")) & ~F.col("pattern").startswith("n:")
    good = per.where(F.col("files") >= MIN_FILES).select("pattern", tool.alias("tool"), copied.alias("copied")).where("tool or copied")
    return rows.join(good, "pattern").where((unread & (F.col("tool") | F.col("copied"))) | (~unread & F.col("copied"))).select("file_path").distinct()


def copies(seen: DataFrame, foreign: DataFrame) -> DataFrame:
    """Paths of plain files whose body equals or resembles (similarity of SIMILARITY or more) the body of a foreign file.

    Equal bodies are one class. Of each bucket of a band only its first foreign class is compared with all others; what that
    does not resolve is compared with every foreign class of its buckets, salted. No bucket is cut.
    """
    plain = seen.where("body is not null")
    marked = plain.join(foreign.select("file_path", F.lit(True).alias("is_foreign")), "file_path", "left")
    classes = materialise(marked.groupBy("body").agg(F.max(F.coalesce("is_foreign", F.lit(False)) | (F.col("shown") == "foreign")).alias("is_foreign"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")), "classes")
    f, u = classes.where("is_foreign"), classes.where("not is_foreign")
    buckets = lambda c, name: c.select(F.col("body").alias(name), F.posexplode("bands").alias("band", "key"))

    def verified(pairs: DataFrame) -> DataFrame:
        a = pairs.join(u.select(F.col("body").alias("u"), F.col("shingles").alias("us")), "u").join(f.select(F.col("body").alias("f"), F.col("shingles").alias("fs")), "f")
        both = F.size(F.array_intersect("us", "fs"))
        return a.where(both >= SIMILARITY * (F.size("us") + F.size("fs") - both)).select("u").distinct()

    fb, ub = buckets(f, "f"), buckets(u, "u")
    star = fb.groupBy("band", "key").agg(F.min("f").alias("f"))
    first = materialise(verified(ub.join(star, ["band", "key"]).select("u", "f").distinct()), "copies")
    rest = ub.join(first, "u", "left_anti").withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS)).cast("int"))
    salted = fb.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    second = verified(rest.join(salted, ["band", "key", "salt"]).select("u", "f").distinct())
    hit = first.unionByName(second).select(F.col("u").alias("body")).unionByName(f.select("body")).distinct()
    return plain.where("shown = 'plain'").join(hit, "body", "left_semi").select("file_path")


def not_handwritten(files: DataFrame, owners: Sequence[str]) -> DataFrame:
    """(file_path, reason) of each file that is not hand-written source of the project."""
    seen = materialise(inspect(files, owners), "inspected")
    shown = seen.where(F.col("shown").isin("foreign", "generated", "minified", "data")).select("file_path", F.col("shown").alias("reason"))
    own = seen.where("shown = 'own'").select("file_path").distinct()
    said = materialise(declared(files), "declared")
    by_pattern = materialise(mine_patterns(seen, said).join(own, "file_path", "left_anti"), "patterns").select("file_path", F.lit("pattern").alias("reason"))
    foreign = shown.where("reason = 'foreign'").select("file_path").unionByName(by_pattern.select("file_path")).distinct()
    copied = copies(seen, foreign).select("file_path", F.lit("copy").alias("reason"))
    judged = shown.unionByName(by_pattern).unionByName(copied).join(said.where("not declared"), "file_path", "left_anti")
    everything = judged.unionByName(said.where("declared").select("file_path", F.lit("declared").alias("reason")))
    w = Window.partitionBy("file_path").orderBy("reason")  # a handful of rows
    return everything.distinct().withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
