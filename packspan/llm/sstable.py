"""Token-id shards as sorted string tables.

A shard file holds documents in ascending key order:

    block*   zstd of entries: varint shared, varint rest, varint value length, key rest, value
    index    for each block: varint key length, first key, varint offset, varint length (zstd of all of it)
    bloom    one bit set of ten bits a key, seven probes
    footer   6 little-endian u64: index offset, index length, bloom offset, bloom length, documents, ids; 8 bytes magic

Keys are 0x00 for a null id and 0x01 with the id as 8 big-endian bytes, sign flipped, so that byte order is numeric
order. ``shared`` counts leading bytes that a key has in common with the one before it in its block. A value is one byte
of width (2 or 4) and the ids at that width, little-endian. A lookup reads the footer, asks the Bloom filter, finds the
block by binary search in the sparse index and scans one block.

Documents are dealt to files by ranges of their ids from approximate quantiles, a file at a time and sorted within, so
memory doesn't depend on a file's size. Rows that share a hot id are dealt over the files between its equal quantiles.
Each attempt of a task writes files of its own names and only a finished task's names reach the manifest, so lost
executors leave unused files at worst.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packspan.llm import wordkernel as K
from packspan.llm.sentencepiece_fst import ragged
from packspan.runtime import Cut, fresh_path, ship, table

MAGIC = b"PKSPNSST"
BLOCK_BYTES = 1 << 16
BITS_PER_KEY, PROBES = 10, 7
KEPT_SEGMENTS = 1_000_000
#: Documents of a file, unless that leaves the cluster's cores idle.
FILE_ROWS = 65_536
_FOOTER = struct.Struct("<6Q")


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([int.from_bytes(k[1:] or b"\xff", "big") for k in keys], np.uint64)
    h = K.mix(h + np.uint64(0x9E3779B97F4A7C15))
    step = K.mix(h) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) % np.uint64(bits) for i in range(PROBES)], 1).astype(np.int64)


class Writer:
    """Writes one shard; keys must come in ascending order, equal keys may repeat."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.at = out, block_bytes, 0
        self.block, self.first, self.last, self.index, self.keys = bytearray(), b"", b"", bytearray(), []
        self.docs = self.ids = 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        for x, y in zip(key, self.last, strict=False):
            if x != y:
                break
            shared += 1
        narrow = not len(ids) or int(ids.max()) < 65536
        value = (b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(ids)
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, b: bytes) -> tuple[int, int]:
        where = self.at, len(b)
        self.out.write(b)
        self.at += len(b)
        return where

    def _flush(self) -> None:
        if self.block:
            at, size = self._put(self.zip.compress(bytes(self.block)))
            self.index += varint(len(self.first)) + self.first + varint(at) + varint(size)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index = self._put(self.zip.compress(bytes(self.index)))
        bits = max(64, -(-len(self.keys) * BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for lo in range(0, len(self.keys), 65536):
            bloom[_probes(self.keys[lo : lo + 65536], bits)] = True
        where = self._put(np.packbits(bloom, bitorder="little").tobytes())
        self.out.write(_FOOTER.pack(*index, *where, self.docs, self.ids) + MAGIC)


class Reader:
    """Reads one shard through a seekable file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = self._get(size - _FOOTER.size - 8, _FOOTER.size + 8)
        if tail[-8:] != MAGIC:
            raise ValueError("not a shard of this format")
        i_at, i_len, self.b_at, self.b_len, self.docs, self.ids = _FOOTER.unpack(tail[:-8])
        raw, at = zstandard.ZstdDecompressor().decompress(self._get(i_at, i_len)), 0
        self.firsts, self.blocks = [], []
        while at < len(raw):
            n, at = read_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            off, at = read_varint(raw, at + n)
            length, at = read_varint(raw, at)
            self.blocks.append((off, length))

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _entries(self, block: tuple[int, int]) -> Iterator[tuple[bytes, np.ndarray]]:
        raw, at, key = zstandard.ZstdDecompressor().decompress(self._get(*block)), 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            rest, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, "<u2" if raw[at] == 2 else "<u4", (size - 1) // raw[at], at + 1)
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for b in self.blocks:
            for key, ids in self._entries(b):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        bloom = np.frombuffer(self._get(self.b_at, self.b_len), np.uint8)
        p = _probes([key_of(doc_id)], len(bloom) * 8)[0]
        return bool((bloom[p >> 3] >> (p & 7) & 1).all())

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of all documents with that id; at most one block is read but for repeated ids."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        b = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while b < len(self.blocks) and self.firsts[b] <= key:
            out += [ids for k, ids in self._entries(self.blocks[b]) if k == key]
            b += 1
        return out


#: What a tokenizer file must say for its texts to be cut: composed characters, one space for white space, lower case; then
#: English endings, runs of letters, single digits and runs of marks, as bytes.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct segment once.

    A tokenizer whose normaliser and pre-tokenizer are those of ``NORMALISER`` and ``SPLIT`` never joins characters across
    ASCII white space, nor across an ASCII letter next to an ASCII mark other than the apostrophe; texts are cut there and
    lower-cased in ASCII, which the normaliser does as well. Runs with ``<|`` (special tokens) or a capital sigma (its lower
    case depends on what follows) are cut at white space only and left as they are. For any other tokenizer nothing is known
    of where texts may be cut, so each text is encoded as a whole.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.loads(self.tokenizer.to_str())
        self.segmented = spec["normalizer"] == NORMALISER and spec["pre_tokenizer"] == SPLIT and all(t["content"].startswith("<|") and not t["normalized"] for t in spec["added_tokens"])
        self._reset()

    def _reset(self) -> None:
        self.known: dict[int, int] = {}  #: segments by hash
        self.first = np.zeros(1 << 12, np.int64)  #: where each segment's ids begin, and one more
        self.arena = np.zeros(1 << 16, np.int32)

    def encode_run(self, run: K.Run) -> tuple[np.ndarray, np.ndarray]:
        if not self.segmented:
            texts = [run.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(run.offsets[:-1], run.offsets[1:], strict=True)]
            ids = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        if len(self.known) > KEPT_SEGMENTS:
            self._reset()
        raw = run.data.tobytes()
        plain = b"<|" in raw or b"\xce\xa3" in raw
        data = run.data if plain else K.LOWER[run.data]
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(run.offsets), np.int64)
        kind = _KIND[data]
        edge = np.empty(n, bool)
        edge[0] = True
        edge[1:] = (kind[1:] == 0) != (kind[:-1] == 0)
        if not plain:
            edge[1:] |= (kind[1:] + kind[:-1] == 3) & (kind[1:] > 0) & (kind[:-1] > 0)
        inner = run.offsets[:-1]
        edge[inner[inner < n]] = True
        starts = np.flatnonzero(edge)
        ends = np.append(starts[1:], n)
        solid = kind[starts] != 0
        starts, ends = starts[solid], ends[solid]
        hashes, index, inverse = np.unique(K.segment_hashes(data, starts, ends), return_index=True, return_inverse=True)
        number = np.fromiter((self.known.get(h, -1) for h in hashes.tolist()), np.int64, len(hashes))
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            raw = raw if plain else data.tobytes()
            at = index[fresh]
            number[fresh] = self._learn(hashes[fresh].tolist(), [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        begin, count = self.first[number], self.first[number + 1] - self.first[number]
        ids, bounds = ragged(self.arena, begin[inverse], count[inverse])
        return ids, bounds[np.searchsorted(starts, run.offsets)]

    def _learn(self, hashes: list[int], segments: list[str]) -> np.ndarray:
        """Numbers of new segments, whose ids are kept."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(segments, add_special_tokens=False)]
        n = len(self.known)
        ends = self.first[n] + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        if n + len(ids) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(len(self.first), len(ids)), np.int64)])
        self.first[n + 1 : n + 1 + len(ids)] = ends
        if ends[-1] > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros(max(len(self.arena), int(ends[-1])), np.int32)])
        self.arena[self.first[n] : ends[-1]] = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1] - self.first[n]))
        self.known.update(zip(hashes, range(n, n + len(ids)), strict=True))
        return np.arange(n, n + len(ids))


#: 0 white space, 1 ASCII letter, 2 ASCII mark, 4 the rest (digits, apostrophe, non-ASCII).
_KIND = np.full(256, 4, np.uint8)
_KIND[K.SPACE] = 0
_KIND[[b for b in range(128) if chr(b).isalpha()]] = 1
_KIND[[b for b in b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~<>"]] = 2
_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _dealt(docs: DataFrame, id_col: str, text_col: str, file_rows: int) -> tuple[DataFrame, int]:
    """Rows (bucket, id, text), buckets ascending with the ids, and the number of buckets."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = base.count()
    cores = spark.sparkContext.defaultParallelism
    n = max(1, -(-total // file_rows), min(3 * cores, -(-total // 1024)))
    if n == 1:
        return base.select(F.lit(0).alias("bucket"), "id", "text"), 1
    cuts = base.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]) if n <= 1000 else F.expr(f"transform(sequence(1, {n - 1}), i -> i / {n}D)"), 10 * n).alias("q")).first()[0] or []
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids, salt):
        known = ids.fillna(0).astype("int64").to_numpy()
        lo, hi = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
        # a hot id spans several equal cuts: its rows go round the buckets between them
        wide = np.maximum(hi - lo, 1)
        out = np.where(hi - lo > 1, lo + 1 + salt.to_numpy() % wide, hi)
        import pandas as pd

        return pd.Series(np.where(ids.isna().to_numpy(), 0, np.minimum(out, len(bounds))).astype(np.int32))

    return base.select(bucket("id", F.monotonically_increasing_id()).alias("bucket"), "id", "text"), n


def write_shards(docs: DataFrame, folder: str | None = None, tokenizer_file: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", file_rows: int = FILE_ROWS) -> DataFrame:
    """Encode all whole texts, write shards below ``folder`` and return the manifest: bucket, path, docs, ids.

    Files in order of buckets hold ascending ids, null ids first. Null texts count as empty; ``end_id`` follows each
    document. Repeated ids are all kept, next to each other in their files and there in order of their texts' hashes. Other columns aren't read. An empty table
    has no file and an empty manifest. The tokenizer's file must be at its path on every executor.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "shards")
    file = tokenizer_file or default_tokenizer()
    dealt, n = _dealt(docs, id_col, text_col, file_rows)
    rows = dealt.repartitionById(n, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("id"), F.xxhash64("text"))
    store, root = open_store(folder)
    store.create_dir(root, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, (fs, base) = encoder(file), open_store(folder)
        made, now, w, out, path = [], None, None, None, ""

        def close() -> None:
            if w is not None:
                w.finish()
                out.close()
                made.append((now, f"{folder}/{path}", w.docs, w.ids))

        end = np.array([end_id], np.int32)
        for batch in batches:
            buckets, ids = batch.column("bucket").to_pylist(), batch.column("id").to_pylist()
            for run in K.runs(batch.column("text")):
                flat, first = enc.encode_run(run)
                for r in range(run.lo, run.hi):
                    if buckets[r] != now:
                        close()
                        now, path = buckets[r], f"part-{buckets[r]:06d}-{uuid.uuid4().hex[:12]}.sst"
                        out = fs.open_output_stream(f"{base}/{path}", compression=None)
                        w = Writer(out)
                    w.add(key_of(ids[r]), np.concatenate([flat[first[r - run.lo] : first[r - run.lo + 1]], end]))
        close()
        cols = list(zip(*made, strict=True)) if made else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["bucket", "path", "docs", "ids"])

    return Cut(rows.mapInArrow(K.tidy(write), "bucket int, path string, docs long, ids long"), "manifest").df


def read_shards(manifest: DataFrame, keep_ids: bool = True) -> DataFrame:
    """One row for each document of the manifest's files: id, start, n_tokens, ids_crc32 and, if asked for, ids.

    ``start`` counts the ids of all documents before it, over files in order of buckets.
    """
    spark = manifest.sparkSession
    ship(spark)
    # a row for each file, not for each document
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = Cut(placed.select("path", "base"), "files")
    n = max(1, files.df.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, path = open_store(uri)
                with fs.open_input_file(path) as f:
                    rows: list[tuple] = []
                    for doc_id, ids in Reader(f):
                        wide = ids.astype("<u4")
                        rows.append((doc_id, base, len(ids), crc32(wide.tobytes()), wide if keep_ids else None))
                        base += len(ids)
                        if len(rows) >= 1024:
                            yield batch_of(rows)
                            rows = []
                    if rows:
                        yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:4]]
        names = ["id", "start", "n_tokens", "ids_crc32"]
        if keep_ids:
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in cols[4]])])
            arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(cols[4]).astype(np.int32))))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names)

    schema = "id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if keep_ids else "")
    return files.df.repartition(n).mapInArrow(K.tidy(read), schema)


def op7_sstable(spark, sf_dir: str) -> DataFrame:
    manifest = write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return read_shards(manifest, keep_ids=False).withColumnRenamed("id", "doc_id")
