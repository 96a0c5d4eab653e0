"""Encoding of a corpus with a public tokenizer.

Method: overlapping chunk encoding. A text is cut into chunks that overlap; the chunks are pre-tokenised in parallel. From a
position where a pre-token begins, a left-to-right scan depends on nothing before it, so two scans that share one boundary
share all later ones: the scans of neighbouring chunks are stitched at a boundary both have in their overlap, and the pieces
between stitches are encoded independently. If two scans do not meet in the overlap (a run without boundaries), the chunks
are not cut there and stay one piece. The ids of the pieces, in order, are the ids of the text. Decoding concatenates raw bytes.

Texts of one chunk need no stitching and are encoded where they lie.

Defined results: null and empty texts have an empty list; strings of special tokens are ordinary text; texts are encoded whole;
one row per row given (doc_id is unique), null doc_ids included; further columns are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.resources import TOKENIZERS
from loomgraph.session import materialise

CHUNK, OVERLAP = 16_384, 1_024
# Fixed value: the published pre-tokenisation pattern of this byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SCAN = regex.compile(PATTERN)
_loaded: dict[str, tiktoken.Encoding] = {}


def encoding(tokenizer_dir: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """The tokenizer, loaded once per process."""
    path = os.path.join(tokenizer_dir, f"{name}.tiktoken")
    if path not in _loaded:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def boundaries(text: str, start: int, lo: int, hi: int) -> list[int]:
    """Positions of the source in [lo, hi) where a pre-token of this chunk begins with white space after a printed character; the chunk starts at `start`.

    No pre-token goes from a printed character on to white space, so each such position is a boundary of the whole text too,
    even if the chunk began within a pre-token and its scan met no other."""
    return [p for m in _SCAN.finditer(text) if lo <= (p := m.start() + start) < hi and m.start() and m.group()[0].isspace() and not text[m.start() - 1].isspace()]


def stitches(ends: list[list[int]], begins: list[list[int]]) -> list[int | None]:
    """Where neighbouring chunks are cut: the last boundary but one that both have; None if there is none.

    The last common one is left out: near the end of a chunk its scan has not seen what follows.
    """
    out: list[int | None] = []
    for e, b in zip(ends, begins):
        both = sorted(set(e) & set(b))
        out.append(both[-2] if len(both) > 1 else None)
    return out


def encode(text: str | None, tokenizer_dir: str = TOKENIZERS) -> list[int]:
    """Ids of one text without special tokens."""
    return encoding(tokenizer_dir).encode_ordinary(text) if text else []


def decode(ids: list[int], tokenizer_dir: str = TOKENIZERS) -> bytes:
    """The raw bytes of ids."""
    enc = encoding(tokenizer_dir)
    return b"".join(enc.decode_single_token_bytes(i) for i in ids)


def _ids(batches: Iterator[pd.DataFrame], keys: list[str], tokenizer_dir: str) -> Iterator[pd.DataFrame]:
    enc = encoding(tokenizer_dir)
    for b in batches:
        out = b[keys].copy()
        out["ids"] = [enc.encode_ordinary(t) if isinstance(t, str) and t else [] for t in b["text"]]
        yield out


def encode_corpus(documents: DataFrame, key: str = "doc_id", tokenizer_dir: str = TOKENIZERS, chunk: int = CHUNK, overlap: int = OVERLAP, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, ids) of every document, with the columns to keep. A long text travels as chunks, then as pieces: never once per chunk."""
    docs = documents.select(F.col(key).alias("doc_id"), *keep, "text")
    named = ["doc_id", *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in named)
    long_text = F.coalesce(F.length("text") > chunk + overlap, F.lit(False))
    short = docs.where(~long_text).mapInPandas(lambda bs: _ids(bs, named, tokenizer_dir), f"{kinds}, ids array<int>")
    # Long texts: chunk, scan in parallel, stitch, encode the pieces in parallel.
    big = materialise(docs.where(long_text).withColumn("row", F.monotonically_increasing_id()), "long")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, text in zip(b["row"], b["text"]):
                starts = [s for s in range(0, len(text), chunk) if s == 0 or s + overlap < len(text)]
                for k, s in enumerate(starts):  # the last chunk goes to the end
                    yield pd.DataFrame({"row": [row], "k": [k], "of": [len(starts)], "start": [s], "text": [text[s : s + chunk + overlap] if k + 1 < len(starts) else text[s:]]})

    chunks = big.select("row", "text").mapInPandas(cut, "row bigint, k int, of int, start bigint, text string").repartition("row", "k")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head, tail = [], []
            for t, s, k, of in zip(b["text"], b["start"], b["k"], b["of"]):
                head.append(boundaries(t, s, s + 1, s + overlap) if k else [])
                tail.append(boundaries(t, s, s + chunk + 1, s + chunk + overlap) if k + 1 < of else [])
            out = b[["row", "k"]].copy()
            out["head"], out["tail"] = head, tail
            yield out

    scanned = chunks.mapInPandas(scan, "row bigint, k int, head array<int>, tail array<int>")
    meta = scanned.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("chunks"))  # boundaries of overlaps only

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, text, cs in zip(b["row"], b["text"], b["chunks"]):
                cuts = [0, *[c for c in stitches([list(c["tail"]) for c in cs[:-1]], [list(c["head"]) for c in cs[1:]]) if c is not None], len(text)]
                for i, (a, z) in enumerate(zip(cuts, cuts[1:])):
                    yield pd.DataFrame({"row": [row], "piece": [i], "text": [text[a:z]]})

    pieces = big.select("row", "text").join(meta, "row").mapInPandas(split, "row bigint, piece int, text string").repartition("row", "piece")
    done = pieces.mapInPandas(lambda bs: _ids(bs, ["row", "piece"], tokenizer_dir), "row bigint, piece int, ids array<int>")
    whole = done.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    out = big.drop("text").join(whole, "row").select(*named, F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))
    return short.unionByName(out)
