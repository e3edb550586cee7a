"""File-name and content search. Every operator works row by row; only paging sorts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspan.functions.paths import _c, name

PAGE_ROWS = 200
SNIPPET_CHARS = 120
POSITION_CHARS = 50_000
SUM_BLOCK = 500
LINE_ENDS = r"\r\n|\r|\n"


def by_name(entries: DataFrame, query: str, path: str = "path") -> DataFrame:
    return entries.where(F.contains(F.lower(name(path)), F.lit(query.lower())))


def by_content(texts: DataFrame, query: str, max_bytes: int | None = 1_000_000, path: str = "path", text: str = "text") -> DataFrame:
    """(path, match_count, first_line, snippet) of the texts with a line that holds the query, whatever the case.

    match_count counts lines, first_line is 1-based, the snippet is the first such line without outer white space, cut to
    120 characters. Texts of ``max_bytes`` (UTF-8) or more are left out, as is everything for an empty query. Lines stay within
    their row: no explode and no shuffle.
    """
    if not query:
        return texts.limit(0).select(F.col(path).alias("path"), F.lit(0).cast("long").alias("match_count"), F.lit(0).alias("first_line"), F.lit("").alias("snippet"))
    rows = texts if max_bytes is None else texts.where(F.octet_length(text) < max_bytes)
    q = F.lit(query.lower())
    rows = rows.where(F.contains(F.lower(text), q))
    numbered = F.transform(F.split(text, LINE_ENDS), lambda line, i: F.struct((i + 1).alias("no"), line.alias("line")))
    hits = F.filter(numbered, lambda x: F.contains(F.lower(x["line"]), q))
    rows = rows.select(F.col(path).alias("path"), hits.alias("hits")).where(F.size("hits") > 0)
    line = F.regexp_replace(F.col("hits")[0]["line"], r"^\s+|\s+$", "")
    return rows.select("path", F.size("hits").cast("long").alias("match_count"), F.col("hits")[0]["no"].alias("first_line"), F.substring(line, 1, SNIPPET_CHARS).alias("snippet"))


def page(results: DataFrame, rows: int = PAGE_ROWS, after=None) -> DataFrame:
    """The next page of results by path: a top-k, never a whole sort."""
    left = results if after is None else results.where(F.col("path") > F.lit(after))
    return left.orderBy("path").limit(rows)


def _running(lengths: Column) -> Column:
    """The running sums of ``lengths``, each and 1; in blocks, so that appending costs no square of the array's size."""
    none = F.array().cast("array<int>")

    def sums(block: Column) -> Column:
        return F.aggregate(block, F.struct(F.lit(0).alias("at"), none.alias("found")), lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["found"], acc["at"] + n).alias("found")), lambda acc: acc["found"])

    def blocks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(every), F.lit(SUM_BLOCK)), lambda i: sums(F.slice(every, i, F.lit(SUM_BLOCK))))

    # a lambda's variable holds its value; a column named twice would be worked out twice
    parts = F.transform(F.array(lengths), blocks)[0]
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<int>>").alias("found"))
    return F.flatten(F.aggregate(parts, start, lambda acc, p: F.struct((acc["at"] + F.element_at(p, -1)).alias("at"), F.array_append(acc["found"], F.transform(p, lambda e: e + acc["at"])).alias("found")), lambda acc: acc["found"]))


def positions(text: str | Column, query: str, within: int | None = POSITION_CHARS) -> Column:
    """1-based places of all matches, overlapping ones too, whatever the case, in the first ``within`` characters.

    ``None`` is the whole text.

    The text is split before each match by a lookahead, so the regular expression engine goes through it once; the places
    are the running lengths of the pieces.
    """
    t = F.lower(_c(text) if within is None else F.substring(_c(text), 1, within))
    ends = _running(F.transform(F.split(t, f"(?={re.escape(query.lower())})"), F.length))
    later = F.transform(F.array(ends), lambda e: F.slice(e, 1, F.size(e) - 1))[0]  # the last piece ends with the text
    first = F.when(F.startswith(t, F.lit(query.lower())), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return F.concat(first, later)


def nearest(text: str | Column, query: str, target_line: int | Column) -> Column:
    """The first of the 1-based match lines that is closest to ``target_line``; null without a match."""
    target = F.lit(target_line) if isinstance(target_line, int) else target_line
    lines = F.transform(F.split(_c(text), LINE_ENDS), lambda line, i: F.when(F.contains(F.lower(line), F.lit(query.lower())), i + 1))
    return F.array_min(F.transform(F.filter(lines, lambda i: i.isNotNull()), lambda i: F.struct(F.abs(i - target).alias("far"), i.alias("line"))))["line"]


def in_archives(entries: DataFrame, members: DataFrame, query: str, max_bytes: int = 1_000_000) -> DataFrame:
    """Hits in names of all entries, and in contents of text members(archive, path, content); one row for each path hit."""
    from packspan.functions.scalars import is_text_name

    texts = members.where(is_text_name(name("path")) & (F.octet_length("content") < max_bytes)).select(F.struct("archive", "path").alias("path"), F.decode("content", "UTF-8").alias("text"))
    hits = by_content(texts, query, None).select("path.archive", "path.path", "match_count", "first_line", "snippet")
    names = by_name(entries, query).select("archive", "path", F.lit(0).cast("long").alias("match_count"), F.lit(0).alias("first_line"), F.lit("").alias("snippet"))
    return hits.unionByName(names.join(hits.select("archive", "path"), ["archive", "path"], "left_anti"))
