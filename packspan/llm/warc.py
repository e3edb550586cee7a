"""WARC archives with globally ordered capture histories, by an external index merge.

1. Payloads are digested natively (SHA-1). Of the records with equal payloads the smallest page is the response, the
   others become revisits; only digests that occur twice are looked up.
2. Each task writes one archive, a gzip member a record, and an index run: its captures sorted by URL key and timestamp,
   in chunks of ``CHUNK`` rows with a sparse table of first keys.
3. While there are more than ``FAN_IN`` runs, groups of so many are merged into longer runs, a task a group. The sparse tables
   of the runs left, a row for each chunk, give the key ranges of the last merge: its tasks open the chunks of every run
   that overlap their range as streams and merge them through a loser tree. A merge opens at most ``FAN_IN`` files, makes
   log2(``FAN_IN``) comparisons a capture, holds one chunk of each run and hands its captures on in batches.
4. Records are read back at the merged index's offsets, file by file within a slice of it.

All rows with a hot URL key are ordered by timestamp and page as well, and ranges are cut on the whole triple, so a hot
key is split like any other. Tasks write files of their own names and only finished tasks' names are read later.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspan.runtime import Cut, fresh_path, ship, table

CHUNK = 1024
#: Captures of a merge range, unless that leaves the cluster's cores idle.
RANGE_ROWS = 1 << 20
FAN_IN = 128  #: runs of a merge
BATCH = 8_192  #: captures that a merge hands on at once
BROADCAST_ROWS = 500_000
_TAIL = struct.Struct("<QQ")
#: Fixed values of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly form of a URL: host labels reversed, port, path and query, in lower case; scheme and fragment go."""
    if not url:
        return ")"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return ")" + url.strip().lower()
    labels = [x for x in host.removeprefix("www.").split(".") if x]
    at = f":{port}" if port and port not in (80, 443) else ""
    query = "?" + "&".join(sorted(u.query.split("&"))) if u.query else ""
    return f"{','.join(reversed(labels))}{at}){u.path.rstrip('/') or '/'}{query}".lower()


def record(page_id, url: str | None, when: str, kind: str, digest: str, size: int, payload: bytes, refers_to, refers_url: str | None) -> bytes:
    """One WARC record. The page, and the size of a revisit's payload, stand in extension fields."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'packspan:{page_id}:{clean}')}>",
        f"WARC-Date: {when}",
        f"WARC-Target-URI: {clean}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Target-URI: {(refers_url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("a record's block doesn't have the length it states")
    return fields, rest[:size]


class LoserTree:
    """k-way merge: each inner node holds the loser of its match, so the next smallest costs one match a level."""

    def __init__(self, streams: list[Iterator[tuple]]):
        self.streams, self.k = streams, max(1, len(streams))
        self.heads = [next(s, None) for s in streams] or [None]
        self.losers = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = i  # waits for its opponent while the tree is built
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.losers[0]]) is not None:
            yield head
            i = self.losers[0]
            self.heads[i] = next(self.streams[i], None)
            self._play(i)


# A capture in an index run: (url key, timestamp, page, archive, offset, length); page None sorts first.
def _order(c: tuple) -> tuple:
    return c[0], c[1], c[2] is not None, c[2] or 0


def _pack(rows: list[tuple]) -> bytes:
    keys = [r[0].encode() for r in rows]
    archives = {a: i for i, a in enumerate(dict.fromkeys(r[3] for r in rows))}
    nums = np.array([[r[1], r[2] or 0, r[2] is not None, archives[r[3]], r[4], r[5], len(k)] for r, k in zip(rows, keys, strict=True)], "<i8")
    names = "\n".join(archives).encode()
    return zlib.compress(struct.pack("<II", len(rows), len(names)) + names + nums.tobytes() + b"".join(keys), 1)


def _unpack(raw: bytes) -> list[tuple]:
    raw = zlib.decompress(raw)
    n, size = struct.unpack_from("<II", raw)
    names = raw[8 : 8 + size].decode().split("\n")
    at, out = 8 + size + 56 * n, []
    for t, page, has, archive, off, length, k in np.frombuffer(raw, "<i8", 7 * n, 8 + size).reshape(n, 7).tolist():
        out.append((raw[at : at + k].decode(), t, page if has else None, names[archive], off, length))
        at += k
    return out


_CHUNKS = ["run", "index", "chunk", "offset", "length", "n", "url_key", "ts", "page_id"]
_CHUNKS_DDL = "run string, index string, chunk long, offset long, length long, n long, url_key string, ts long, page_id long"
_CHUNK_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]


def _write_run(folder: str, captures: Iterable[tuple]) -> pa.RecordBatch:
    """An index run of captures in order, and its chunk table."""
    fs, base = pafs.FileSystem.from_uri(folder)
    name, rows, at, part = uuid.uuid4().hex, [], 0, []
    with fs.open_output_stream(f"{base}/{name}.idx", compression=None) as f:

        def put() -> int:
            packed = _pack(part)
            f.write(packed)
            rows.append((name, f"{folder}/{name}.idx", len(rows), at, len(packed), len(part), *part[0][:3]))
            return at + len(packed)

        for c in captures:
            part.append(c)
            if len(part) == CHUNK:
                at, part = put(), []
        if part:
            put()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CHUNK_KINDS, strict=True)], _CHUNKS)


def _stream(chunks: list[dict]) -> Iterator[tuple]:
    """Captures of a run's chunks, each as its order and the rest."""
    fs, path = pafs.FileSystem.from_uri(chunks[0]["index"])
    with fs.open_input_file(path) as f:
        for p in chunks:
            f.seek(p["offset"])
            for c in _unpack(f.read(p["length"])):
                yield (*_order(c), *c[3:])


def _by_run(batches: Iterable[pa.RecordBatch]) -> tuple[list[list[dict]], dict]:
    """A group's chunks in order, run by run, and its first row."""
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["run"], r["chunk"]))
    runs: dict[str, list[dict]] = {}
    for r in rows:
        runs.setdefault(r["run"], []).append(r)
    return list(runs.values()), rows[0]


def _stamp(epoch: int) -> str:
    return str(np.datetime64(epoch, "s")) + "Z"


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, base_time: int = 1_704_067_200) -> DataFrame:
    """Write a record for each row of pages(page_id, url, html) and return the index runs' chunk tables.

    The payload is the html in UTF-8, null counting as empty. Of rows with equal payloads of at least ``min_bytes`` the
    smallest page_id is a response and the others are revisits of it; rows with a null page_id are responses, and of rows
    that share the smallest page_id one is, those that repeat it are revisits of it. Captures are dated ``base_time``
    plus page_id seconds (pages has no capture time). Returned columns: run, archive, index, chunk, offset, length, n and
    the chunk's first url_key, ts and page_id.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "warc")
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.sha1(body).alias("sha"), F.monotonically_increasing_id().alias("row"))
    long_enough = base.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull())
    first = long_enough.groupBy("sha").agg(F.min(F.struct("page_id", "row", "url")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = Cut(first.select("sha", F.col("f.page_id").alias("to"), F.col("f.row").alias("to_row"), F.col("f.url").alias("to_url")), "repeated")
    again = F.broadcast(first.df) if first.df.count() <= BROADCAST_ROWS else first.df
    rows = base.join(again, "sha", "left")
    revisit = F.col("to").isNotNull() & F.col("page_id").isNotNull() & (F.octet_length("html") >= min_bytes) & (F.col("row") != F.col("to_row"))
    rows = rows.select("page_id", "url", "html", "sha", F.when(revisit, F.col("to")).alias("to"), F.when(revisit, F.col("to_url")).alias("to_url"))

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, captures, out, at = uuid.uuid4().hex, [], None, 0
        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "sha", "to", "to_url")]
            for lo in range(0, batch.num_rows, 256):
                for page, url, html, sha, to, to_url in zip(*(c.slice(lo, 256).to_pylist() for c in cols), strict=True):
                    if out is None:
                        out = fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None)  # records are gzip members already
                    payload, when = html.encode(), base_time + (page or 0)
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    z = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = record(page, url, _stamp(when), "revisit" if to is not None else "response", digest, len(payload), payload, to, to_url)
                    packed = z.compress(raw) + z.flush()
                    out.write(packed)
                    captures.append((url_key(url), when, page, f"{folder}/{name}.warc.gz", at, len(packed)))
                    at += len(packed)
        if out is None:
            return
        out.close()
        captures.sort(key=_order)
        yield _write_run(folder, captures)

    return Cut(rows.mapInArrow(write, _CHUNKS_DDL), "chunks").df


_INDEX = "range int, pos long, url_key string, ts long, page_id long, archive string, offset long, length long"


def fewer_runs(chunks: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """The chunk tables of at most ``fan_in`` runs with the same captures: groups of runs are merged, as often as needed."""
    spark = chunks.sparkSession
    ship(spark)
    while True:
        # a row for each run
        runs = chunks.select("run").distinct()
        count = runs.count()
        if count <= fan_in:
            return chunks
        folder = fresh_path(spark, "runs")
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        numbered = runs.select("run", F.floor((F.row_number().over(Window.orderBy("run")) - 1) / fan_in).cast("int").alias("grp"))

        def merge(batches: Iterator[pa.RecordBatch], folder: str = folder) -> Iterator[pa.RecordBatch]:
            parts, _ = _by_run(batches)
            yield _write_run(folder, ((c[0], c[1], c[3] if c[2] else None, *c[4:]) for c in LoserTree([_stream(p) for p in parts])))

        chunks = Cut(chunks.join(numbered, "run").groupBy("grp").applyInArrow(_one_argument(merge), _CHUNKS_DDL), "chunks").df


def _one_argument(work):
    """``work`` as a function of batches alone, in the form that grouped Arrow functions are told by."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)

    return apply


def merged_index(chunks: DataFrame, range_rows: int = RANGE_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """The global index: captures of all runs in order of (url_key, ts, page_id), numbered by pos within ascending ranges.

    Ranges are cut at quantiles of the chunks' first triples, weighted alike, as chunks are of one size; a range so holds
    at most its share and one chunk of each run more.
    """
    spark = chunks.sparkSession
    ship(spark)
    chunks = fewer_runs(chunks, fan_in)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-total // range_rows), min(cores, -(-total // CHUNK)))
    # a chunk for each 1024 captures: this table, not the captures, is ordered here, and only n bounds come to the driver
    keys = chunks.select(F.struct("url_key", "ts", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("page")).alias("k"))
    total_chunks = keys.count()
    every = max(1, total_chunks // n)
    ordered = keys.repartitionByRange(max(1, min(n, cores)), "k").sortWithinPartitions("k")
    bounds = [tuple(r.k) for r in ordered.select("k", (F.monotonically_increasing_id() % (1 << 33)).alias("i")).where((F.col("i") % every == every - 1)).select("k").collect()]
    bounds = sorted(set(bounds))
    lows, highs = [None, *bounds], [*bounds, None]
    last = F.lead("k").over(_run_order())
    spans = chunks.withColumn("k", F.struct("url_key", "ts", F.col("page_id").isNotNull().alias("has"), F.coalesce("page_id", F.lit(0)).alias("page"))).withColumn("next", last)
    shared = spark.sparkContext.broadcast((lows, highs))

    def overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        cuts = shared.value[1][:-1]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                low = (r["url_key"], r["ts"], r["page_id"] is not None, r["page_id"] or 0)
                a = bisect.bisect_right(cuts, low)
                b = len(cuts) if r["next"] is None else bisect.bisect_right(cuts, tuple(r["next"].values()))
                out += [(i, r["run"], r["index"], r["chunk"], r["offset"], r["length"]) for i in range(a, b + 1)]
            if out:
                kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["range", "run", "index", "chunk", "offset", "length"])

    placed = spans.mapInArrow(overlaps, "range int, run string, index string, chunk long, offset long, length long")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, one = _by_run(batches)
        which = one["range"]
        low, high = shared.value[0][which], shared.value[1][which]
        inside = (c for c in LoserTree([_stream(p) for p in runs]) if (low is None or c[:4] >= low) and (high is None or c[:4] < high))
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        pos = 0
        while part := list(islice(inside, BATCH)):
            rows = [(which, pos + i, c[0], c[1], c[3] if c[2] else None, *c[4:]) for i, c in enumerate(part)]
            pos += len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["range", "pos", "url_key", "ts", "page_id", "archive", "offset", "length"])

    return placed.groupBy("range").applyInArrow(merge, _INDEX)


def _run_order():
    return Window.partitionBy("run").orderBy("chunk")


def read_captures(index: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records at the index's offsets: its columns and payload_bytes, payload_digest, record_type, refers_to, url and,
    if asked for, payload (null for revisits). A response whose payload doesn't match its digest raises an error."""
    ship(index.sparkSession)
    names = ["payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * keep_payload

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            archives, offsets, lengths = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            found: list[tuple] = [()] * len(archives)
            opened, now = None, None
            for i in sorted(range(len(archives)), key=lambda i: (archives[i], offsets[i])):
                if archives[i] != now:
                    if opened is not None:
                        opened.close()
                    fs, path = pafs.FileSystem.from_uri(archives[i])
                    opened, now = fs.open_input_file(path), archives[i]
                opened.seek(offsets[i])
                fields, block = parse(zlib.decompress(opened.read(lengths[i]), 31))
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                if kind == "response":
                    if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                        raise ValueError(f"payload at {archives[i]}:{offsets[i]} doesn't match its digest")
                    size, to = len(block), None
                else:
                    size, to = int(fields["X-Payload-Length"]), int(fields["X-Refers-To-Page-ID"])
                found[i] = (size, digest, kind, to, fields["WARC-Target-URI"], *([block if kind == "response" else None] * keep_payload))
            if opened is not None:
                opened.close()
            cols = list(zip(*found, strict=True)) if found else [()] * len(names)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], [*batch.schema.names, *names])

    return index.mapInArrow(read, f"{_INDEX}, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * keep_payload)


def op10_warc(spark, sf_dir: str) -> DataFrame:
    chunks = write_archives(table(spark, sf_dir, "pages"))
    return read_captures(merged_index(chunks)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
