"""Path algebra of archive members, as native column expressions.

A normalised path has forward slashes only, none at either end, and isn't empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise(path: str | Column) -> Column:
    """Backslashes become slashes, outer slashes go; null if nothing is left."""
    p = F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.when(p != "", p)


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def ancestors(path: str | Column, with_self: bool = False) -> Column:
    """Proper directory prefixes of a path, nearest the root first, empty ones left out."""
    parts = _segments(_c(path))
    last = F.size(parts) - (0 if with_self else 1)
    upto = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(upto, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")), lambda p: p != "")


def name(path: str | Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(_c(path), "/", -1)


def parent(path: str | Column) -> Column:
    """What precedes the last slash; empty at the root."""
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def depth(path: str | Column) -> Column:
    """Number of slashes."""
    return (F.length(_c(path)) - F.length(F.replace(_c(path), F.lit("/"), F.lit("")))).cast("int")


def extension(file_name: str | Column) -> Column:
    """Lower-cased text after the last dot; the whole name if it has none."""
    return F.lower(F.substring_index(_c(file_name), ".", -1))


def stem(file_name: str | Column) -> Column:
    """The name without its last suffix; names without one, or with a leading dot only, stay."""
    s = F.regexp_extract(_c(file_name), r"^(.+)\.[^.]*$", 1)
    return F.when(s == "", _c(file_name)).otherwise(s)


def join_error(path: str | Column) -> Column:
    """Why a member may not be written below a root; null if it may.

    Absolute paths, parent steps, colons (drives and streams) and NUL are refused, as is a path with no segment left.
    """
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    parts = _segments(p)
    kept = F.filter(parts, lambda s: (s != "") & (s != "."))
    return (
        F.when(p.isNull(), "empty archive path")
        .when(p.startswith("/"), "absolute path")
        .when(F.contains(p, F.lit("\0")), "NUL in path")
        .when(F.contains(p, F.lit(":")), "colon in path")
        .when(F.exists(parts, lambda s: s == ".."), "parent step in path")
        .when(F.size(kept) == 0, "empty archive path")
    )


def safe_join(root: str | Column, path: str | Column) -> Column:
    """The destination below ``root``; null where ``join_error`` says why not."""
    root = F.lit(root) if isinstance(root, str) else root
    kept = F.filter(_segments(F.replace(_c(path), F.lit("\\"), F.lit("/"))), lambda s: (s != "") & (s != "."))
    return F.when(join_error(path).isNull(), F.concat(root, F.lit("/"), F.array_join(kept, "/")))


def numbered(file_name: str | Column, n: str | Column) -> Column:
    """``name (n).ext`` for n > 0, cut at the last dot; the name itself for 0."""
    f, n = _c(file_name), _c(n)
    suffix = F.regexp_extract(f, r"^.+(\.[^.]*)$", 1)
    head = F.substring(f, F.lit(1), F.length(f) - F.length(suffix))
    return F.when(n > 0, F.concat(head, F.lit(" ("), n.cast("string"), F.lit(")"), suffix)).otherwise(f)
