"""Files of a working tree: listings by version control or by walking, contents as a table, path aliases."""

from __future__ import annotations

import json
import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import rules

# Languages by the extension of a file.
LANGUAGES = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala", "sh": "bash", "sql": "sql"}


def _git(root: str, *args: str) -> list[str]:
    out = subprocess.run(["git", "-C", root, *args, "-z"], capture_output=True, timeout=120, check=False)
    return [x for x in out.stdout.decode("utf-8", "replace").split("\0") if x] if out.returncode == 0 else []


def tracked(root: str) -> list[str]:
    """Tracked paths."""
    return _git(root, "ls-files")


def untracked(root: str) -> list[str]:
    """Paths neither tracked nor ignored."""
    return _git(root, "ls-files", "--others", "--exclude-standard")


def changed(root: str, base: str = "HEAD~1") -> list[str]:
    """Paths changed since a base (of a rename both) and untracked ones."""
    fields, out = _git(root, "diff", "--name-status", base), []
    while fields:
        n = 2 if fields.pop(0)[:1] in ("R", "C") else 1
        out += fields[:n]
        fields = fields[n:]
    return sorted({*out, *untracked(root)})


def staged_and_unstaged(root: str) -> list[str]:
    """Paths that differ from the last commit, and untracked ones."""
    return sorted({*_git(root, "diff", "--name-only", "HEAD"), *untracked(root)})


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """(file_path): the paths of a working tree; a tree without version control is walked."""
    paths = sorted({*tracked(root), *untracked(root)}) or [str(p.relative_to(root)) for p in Path(root).rglob("*") if p.is_file()]
    return spark.createDataFrame([(p,) for p in paths], "file_path string").where(~rules.ignored(F.col("file_path")))


def contents(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, byte_size, file_hash): files below a root, read by the executors; binary content (a zero byte) is null."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.when(F.position(F.lit(b"\x00"), F.col("content")) == 0, F.decode("content", "UTF-8"))
    return raw.select(F.regexp_replace("path", "^file:", "").alias("file_path"), text.alias("content"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("file_hash"))


def language_of(path):
    """The language of a path by its extension; null if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    c = F.lit(None).cast("string")
    for k, v in LANGUAGES.items():
        c = F.when(ext == k, F.lit(v)).otherwise(c)
    return c


def custom_languages(table: dict) -> dict[str, str]:
    """Extensions of user-defined languages: {name: {"extensions": [...]}}; entries that clash with built-in ones or are malformed are refused."""
    out: dict[str, str] = {}
    for name, entry in table.items():
        exts = entry.get("extensions") if isinstance(entry, dict) else None
        if not re.fullmatch(r"[a-z][a-z0-9_]*", name) or not isinstance(exts, list):
            raise ValueError(f"language {name!r} is malformed")
        for e in exts:
            if not re.fullmatch(r"\.[A-Za-z0-9]+", str(e)) or e[1:].lower() in LANGUAGES or e[1:].lower() in out:
                raise ValueError(f"extension {e!r} of {name!r} can't be used")
            out[e[1:].lower()] = name
    return out


def path_aliases(config_path: str) -> dict[str, list[str]]:
    """Path aliases of a compiler configuration with comments, base configurations first, as absolute patterns."""
    p = Path(config_path)
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m.group(1) or "", p.read_text(encoding="utf-8"))
    conf = json.loads(re.sub(r",\s*([}\]])", r"\1", text))
    out: dict[str, list[str]] = {}
    base = conf.get("extends")
    if isinstance(base, str) and base.startswith("."):
        q = (p.parent / base).with_suffix(".json") if not base.endswith(".json") else p.parent / base
        if q.exists() and q != p:
            out |= path_aliases(str(q))
    opts = conf.get("compilerOptions", {})
    root = p.parent / opts.get("baseUrl", ".")
    return out | {k: [str((root / v).resolve()) for v in vs] for k, vs in opts.get("paths", {}).items()}


def resolve_alias(name: str, aliases: dict[str, list[str]]) -> list[str]:
    """Paths an imported name may mean, by the alias with the longest fixed beginning."""
    best: list[str] = []
    length = -1
    for k, vs in aliases.items():
        head, star, tail = k.partition("*")
        if (star and name.startswith(head) and name.endswith(tail) and len(name) >= len(head) + len(tail) or k == name) and len(head) > length:
            mid = name[len(head) : len(name) - len(tail)] if star else ""
            best, length = [v.replace("*", mid, 1) for v in vs], len(head)
    return best
