"""Qualified names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def posix_name(c: Column) -> Column:
    """Read a backslash as a slash in the part before the first '::'; null stays null."""
    at = F.instr(c, "::")
    split = F.when(at > 0, at - 1).otherwise(F.length(c))
    read = F.concat(F.translate(F.substring(c, F.lit(1), split), "\\", "/"), F.substring(c, split + 1, F.length(c)))
    return F.when(F.contains(c, F.lit("\\")), read).otherwise(c)  # few names hold a backslash


def name_key(c: Column) -> tuple[Column, Column]:
    """The two hashes of a name as posix_name reads it."""
    name = posix_name(c)
    return F.when(c.isNotNull(), F.xxhash64(name)), F.when(c.isNotNull(), F.xxhash64(F.lit("second"), name))


def path_of(c: Column) -> Column:
    """The file part of a qualified name."""
    return F.substring_index(c, "::", 1)


def below_checkout(c: Column) -> Column:
    """A path below its checkout, the third folder from the root; a path not so deep stays without its leading slash."""
    return F.regexp_replace(c, r"^/(?:[^/]+/[^/]+/[^/]+/)?", "")


def base_name(c: Column) -> Column:
    """The last path segment."""
    return F.substring_index(c, "/", -1)


def hash128(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a string under different prefixes; both null for null."""
    return F.when(c.isNotNull(), F.xxhash64(c)), F.when(c.isNotNull(), F.xxhash64(F.lit("second"), c))
