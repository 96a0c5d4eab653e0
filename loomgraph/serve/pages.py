"""Pages of a bounded result: a cursor is bound to the query and to the state of the graph, and refused for another."""

from __future__ import annotations

import base64
import hashlib
import json
import math
from typing import Any

from pyspark.sql import DataFrame


class CursorError(ValueError):
    """A cursor that does not belong to this query or to this state of the graph."""


def digest(*parts: Any) -> str:
    """A short digest of JSON values, independent of the order of keys."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def encode_cursor(offset: int, query: str, provenance: str) -> str:
    """An opaque cursor."""
    return base64.urlsafe_b64encode(json.dumps([offset, query, provenance]).encode()).decode().rstrip("=")


def decode_cursor(token: str, query: str, provenance: str) -> int:
    """The offset of a cursor."""
    try:
        offset, q, p = json.loads(base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)))
    except ValueError as e:
        raise CursorError("unreadable cursor") from e
    if not isinstance(offset, int) or offset < 0:
        raise CursorError("unreadable cursor")
    if q != query:
        raise CursorError("cursor of another query")
    if p != provenance:
        raise CursorError("the graph has changed since")
    return offset


def tokens_of(value: Any) -> int:
    """Tokens of a JSON value at four characters a token."""
    return math.ceil(len(json.dumps(value, default=str)) / 4)


def fit(items: list[dict], budget: int) -> list[dict]:
    """The longest prefix of items within a token budget."""
    used, out = 0, []
    for x in items:
        used += tokens_of(x)
        if used > budget:
            break
        out.append(x)
    return out


def page(df: DataFrame, order: list[str], limit: int, cursor: str | None, name: str, args: dict, provenance: str, budget: int | None = None) -> dict:
    """An envelope with one page of a result in a total order, and a cursor for the next."""
    key = digest(name, args)
    start = decode_cursor(cursor, key, provenance) if cursor else 0
    rows = [r.asDict(recursive=True) for r in df.orderBy(*order).offset(start).limit(limit + 1).collect()]  # a page
    more, rows = len(rows) > limit, rows[:limit]
    kept = fit(rows, budget) if budget is not None else rows
    truncated = len(kept) < len(rows)
    following = encode_cursor(start + len(kept), key, provenance) if kept and (more or truncated) else None
    return {"ok": True, "tool": name, "data": kept, "page": {"offset": start, "returned": len(kept), "has_more": bool(more or truncated), "next_cursor": following}, "truncated": truncated}


def failure(name: str, code: str, message: str) -> dict:
    """An envelope of an error."""
    return {"ok": False, "tool": name, "error": {"code": code, "message": message}}
