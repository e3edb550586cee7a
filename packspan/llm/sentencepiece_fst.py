"""SentencePiece encoding and decoding as shortest paths through weighted finite-state transducers.

A model file is compiled, once and on the driver, into three machines over the tropical semiring (weights add along a path,
the least path wins); tasks get them as flat arrays, a few MB, by broadcast.

* ``Normaliser``: the model's character map as a transducer of leftmost longest matches, white space rules, dummy prefix.
* ``Lexicon``: an automaton over bytes whose accepting states write a piece. Its arcs weigh a piece's negative score in a
  unigram model and 0 in a BPE model. A character that no piece spells has an arc of its own, the byte fallback.
* ``Merges``: the constraint, an acceptor of piece sequences. For unigram models it has one state. For BPE models its states
  are the last piece: a piece may follow another with weight 0 if merging the characters of the two by the model's scores
  gives just these two, else with infinite weight. A sequence whose neighbours may all follow each other is what merging gives
  for the whole text, so the shortest path is exact. Arcs are made when first asked for and kept in a table of fixed size.

An input is normalised, composed with the lexicon for all its positions at once, which gives a lattice, and the lattice with
the constraint while its shortest paths are found, in order of positions and for all chunks of a slice at once. A chunk
begins where a run of spaces does, as no piece has a space after another character (a model that breaks this has one chunk
a text); equal chunks of a slice are composed once. Sums are of a chunk's own weights, in double precision.

Decoding inverts the lexicon: ids write their pieces' bytes, U+2581 becomes a space, and the dummy prefix goes.

Memory: a run or a longer text, about 20 bytes for each of its bytes, and one slice's lattice. Chunks of more than ``LONG``
bytes are walked one by one, a window of ``WINDOW`` bytes of lattice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packspan.llm import wordkernel as K
from packspan.runtime import ship, table

MARK = "▁"
SLICE = 1 << 19  #: bytes of text whose distinct chunks are composed at once
LONG = 96
WINDOW = 1 << 16
PAIR_BITS = 19  #: slots for arcs of the constraint
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_NONE, _FALLBACK = -1, -2


class Automaton:
    """A deterministic acceptor of byte strings; a string's final state holds its number."""

    def __init__(self, strings: list[bytes]):
        self.longest = max(map(len, strings), default=0)
        size = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer(b"".join(strings), np.uint8)
        at = np.concatenate([[0], np.cumsum(size)])[:-1] if len(strings) else size
        state, keys, states = np.zeros(len(strings), np.int64), [], 1
        final: list[tuple[np.ndarray, np.ndarray]] = []
        live = np.arange(len(strings))
        for depth in range(self.longest):
            live = live[size[live] > depth]
            key = state[live] * 256 + flat[at[live] + depth]
            new, inverse = np.unique(key, return_inverse=True)
            keys.append(new)
            state[live] = states + inverse
            states += len(new)
            ends = live[size[live] == depth + 1]
            final.append((state[ends], ends))
        self.accept = np.full(states, _NONE, np.int32)
        for s, which in final:
            self.accept[s] = which
        joined = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.arcs = K.Table(joined, np.arange(1, states, dtype=np.int32))
        self.root = self.arcs.get(np.arange(256))  #: states after one byte

    def matches(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All strings that begin at positions ``at`` and end by ``stop``: start, end and number, by length."""
        starts, ends, numbers = [], [], []
        state, depth = self.root[data[at]], 1
        while True:
            live = state >= 0
            at, stop, state = at[live], stop[live], state[live]
            if not len(at):
                break
            number = self.accept[state]
            hit = number >= 0
            starts.append(at[hit])
            ends.append(at[hit] + at.dtype.type(depth))
            numbers.append(number[hit])
            inside = at + depth < stop
            at, stop = at[inside], stop[inside]
            state = self.arcs.get(state[inside] * np.int64(256) + data[at + depth])
            depth += 1
        if not starts:
            z = np.zeros(0, np.int64)
            return z, z, z.astype(np.int32)
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(numbers)


def character_map(blob: bytes) -> dict[bytes, bytes]:
    """The entries of a model's compiled character map: a double-array trie, then zero-terminated replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").tolist(), blob[4 + size :]
    out, todo = {}, [(0, b"")]
    while todo:
        node, prefix = todo.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 0x200) >> 6))
        if prefix and unit & 0x100:
            at = units[base] & 0x7FFFFFFF
            out[prefix] = texts[at : texts.index(b"\0", at)]
        for byte in range(1, 256):
            child = base ^ byte
            if child < len(units) and units[child] & 0x800000FF == byte:
                todo.append((child, prefix + bytes([byte])))
    return out


class Normaliser:
    """Raw bytes of rows to normalised ones, in which a byte 32 stands for U+2581."""

    def __init__(self, spec):
        entries = sorted(character_map(spec.precompiled_charsmap).items())
        if not spec.escape_whitespaces:
            raise ValueError("models that don't escape spaces are not supported")
        self.map = Automaton([k for k, _ in entries]) if entries else None
        size = [len(v) for _, v in entries]
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.flat = np.frombuffer(b"".join(v for _, v in entries), np.uint8)
        self.trim, self.prefix = spec.remove_extra_whitespaces, spec.add_dummy_prefix

    @staticmethod
    def _splice(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, put: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``data`` with its parts [start, end) replaced by ``count`` bytes each of ``put``."""
        grow = np.concatenate([[0], np.cumsum(count - (end - start))])
        out = np.empty(len(data) + int(grow[-1]), np.uint8)
        inside = np.zeros(len(data) + 1, np.int32)
        np.add.at(inside, start, 1)
        np.add.at(inside, end, -1)
        keep = np.cumsum(inside)[:-1] == 0
        where = np.flatnonzero(keep)
        out[where + grow[np.searchsorted(start, where, "right")]] = data[where]
        begin = start + grow[:-1]
        out[np.repeat(begin - np.concatenate([[0], np.cumsum(count)])[:-1], count) + np.arange(int(count.sum()))] = put
        return out, offsets + grow[np.searchsorted(start, offsets, "left")]

    def apply(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.map is not None and len(data):
            stop = np.repeat(offsets[1:], np.diff(offsets))
            at = np.flatnonzero((data & 0xC0) != 0x80)
            start, end, number = self.map.matches(data, at, stop[at])
            order = np.lexsort((-end, start))
            taken, reach = [], 0
            for i in order.tolist():  # leftmost, longest
                if start[i] >= reach:
                    taken.append(i)
                    reach = int(end[i])
            if taken:
                i = np.array(taken)
                put, bounds = ragged(self.flat, self.first[number[i]], self.first[number[i] + 1] - self.first[number[i]])
                data, offsets = self._splice(data, offsets, start[i], end[i], put, np.diff(bounds))
        if self.trim:
            keep = data != 32
            keep[1:] |= data[:-1] != 32
            head = offsets[:-1][np.diff(offsets) > 0]
            keep[head] = data[head] != 32
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        data, offsets = self._marks(data, offsets)
        if self.trim and len(data):
            last = np.maximum.accumulate(np.where(data != 32, np.arange(len(data)), -1))
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            tail = last[np.maximum(offsets[1:] - 1, 0)]
            keep = np.arange(len(data)) <= tail[row]
            data, offsets = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
        if self.prefix:
            size = np.diff(offsets)
            data = np.insert(data, offsets[:-1][size > 0], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(size > 0)])
        return data, offsets

    @staticmethod
    def _marks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """U+2581 as byte 32."""
        at = np.flatnonzero(data[:-2] == 0xE2) if len(data) > 2 else np.zeros(0, np.int64)
        at = at[(data[at + 1] == 0x96) & (data[at + 2] == 0x81)]
        if not len(at):
            return data, offsets
        keep = np.ones(len(data), bool)
        keep[at + 1] = keep[at + 2] = False
        data = data.copy()
        data[at] = 32
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class Merges:
    """The constraint of a BPE model: which piece may follow which."""

    def __init__(self, pieces: list[str], score: np.ndarray):
        """``pieces`` by number; a piece of no merge (empty) is in no pair."""
        self.n = len(pieces)
        number = {p: i for i, p in enumerate(pieces) if p}
        symbol = dict(number)
        for p in list(number):
            for c in p:
                symbol.setdefault(c, len(symbol) + self.n)
        self.base = max(symbol.values(), default=0) + 1
        pairs: dict[int, int] = {}
        for p, i in number.items():
            for cut in range(1, len(p)):
                x, y = symbol.get(p[:cut]), symbol.get(p[cut:])
                if x is not None and y is not None:
                    pairs[x * self.base + y] = i
        self.pairs = K.Table(np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        self.rank = np.append(np.unique(-score, return_inverse=True)[1] if len(score) else [], 1 << 30).astype(np.int32)  # of no piece: the last
        self.width = max(map(len, pieces), default=0)
        self.letters = np.full((self.n, self.width), -1, np.int32)
        for p, i in number.items():
            self.letters[i, : len(p)] = [symbol[c] for c in p]
        self.size = (self.letters >= 0).sum(1)
        every = np.arange(self.n)
        self.alone = np.zeros(self.n, bool)  #: pieces that merging gives for their own text
        some = every[self.size > 0]
        self.alone[some] = self._merge(self.letters[some], self.size[some], some[:, None])
        self.seen, self.verdict = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "verdict")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.seen, self.verdict = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def _best(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = (x >= 0) & (y >= 0)
        out = np.full(x.shape, _NONE, np.int32)
        out[both] = self.pairs.get(x[both].astype(np.int64) * self.base + y[both])
        return out

    def _merge(self, symbols: np.ndarray, size: np.ndarray, want: np.ndarray) -> np.ndarray:
        """Whether merging each row of symbols, the best score first and the leftmost of equals, ends in the wanted pieces."""
        out = np.zeros(len(symbols), bool)
        for lo, hi in ((0, 8), (8, 16), (16, 32), (32, 1 << 30)):
            row = np.flatnonzero((size > lo) & (size <= hi))
            if not len(row):
                continue
            width = int(size[row].max())
            s = np.concatenate([symbols[row, :width], np.full((len(row), 2), -1, np.int32)], 1)
            joined = self._best(s[:, :-1], s[:, 1:])
            column = np.arange(s.shape[1] - 1)
            while len(row):
                rank = self.rank[joined]
                best = rank.argmin(1)
                each = np.arange(len(row))
                done = rank[each, best] == 1 << 30
                if done.any():
                    end = s[done]
                    out[row[done]] = (end[:, : want.shape[1]] == want[row[done]]).all(1) & (end[:, want.shape[1]] < 0)
                    row, s, joined, best = row[~done], s[~done], joined[~done], best[~done]
                    each = np.arange(len(row))
                    if not len(row):
                        break
                new = joined[each, best]
                shift = column + (column > best[:, None])
                s = np.concatenate([np.take_along_axis(s, shift, 1), np.full((len(row), 1), -1, np.int32)], 1)
                s[each, best] = new
                joined = np.take_along_axis(joined, np.minimum(shift, joined.shape[1] - 1), 1)
                joined[each, best] = self._best(new, s[each, best + 1])
                left = best > 0
                joined[each[left], best[left] - 1] = self._best(s[each[left], best[left] - 1], new[left])
        return out

    def follows(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether the constraint has arcs; a negative ``last`` is the start or a character that no piece spells."""
        out = self.alone[piece]
        k = np.flatnonzero(last >= 0)
        key = last[k].astype(np.int64) * self.n + piece[k]
        slot = K.slots(key, PAIR_BITS)
        found, new = self.verdict[slot], self.seen[slot] != key
        if new.any():
            asked = np.unique(key[new])
            a, b = asked // self.n, asked % self.n
            size = self.size[a] + self.size[b]
            two = np.concatenate([self.letters[a], np.full_like(self.letters[b], -1)], 1)
            column = self.size[a][:, None] + np.arange(self.width)
            np.put_along_axis(two, column, self.letters[b], 1)
            ok = self._merge(two, size, np.stack([a, b], 1))
            at = K.slots(asked, PAIR_BITS)
            self.seen[at], self.verdict[at] = asked, ok
            found[new] = ok[np.searchsorted(asked, key[new])]
        out[k] = found
        return out


class Machine:
    """The compiled model."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        bpe = trainer.model_type == trainer.BPE
        if trainer.treat_whitespace_as_suffix or not (bpe or trainer.model_type == trainer.UNIGRAM):
            raise ValueError("only BPE and unigram models whose spaces begin words are supported")
        self.normaliser = Normaliser(spec)
        self.byte_id, self.unknown = np.full(256, _NONE, np.int32), 0
        surface: list[bytes] = []
        pieces, score = [""] * len(proto.pieces), np.zeros(len(proto.pieces))
        for i, p in enumerate(proto.pieces):
            if p.type == _USER:
                raise ValueError(f"user-defined piece {p.piece!r}")
            if p.type == _BYTE:
                b = int(p.piece[3:5], 16)
                self.byte_id[b] = i
                surface.append(bytes([b]))
            elif p.type == _NORMAL:
                pieces[i], score[i] = p.piece, p.score
                surface.append(p.piece.replace(MARK, " ").encode())
            else:
                self.unknown = i if p.type == _UNKNOWN else self.unknown
                surface.append(trainer.unk_surface.encode() if p.type == _UNKNOWN else b"")
        known = np.array([i for i, p in enumerate(pieces) if p], np.int32)
        self.piece = known  #: by number in the lexicon
        self.lexicon = Automaton([pieces[i].replace(MARK, " ").encode() for i in known])
        self.weight = np.zeros(len(pieces)) if bpe else -score
        self.fallback_weight = 0.0 if bpe else float(10 - score[known].min()) if len(known) else 0.0
        self.merges = Merges(pieces, score) if bpe else None
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.surface_first = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        self.surface_flat = np.frombuffer(b"".join(surface), np.uint8)

    def lattice(self, data: np.ndarray, at: np.ndarray, stop: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Arcs of the composition with the lexicon from character starts ``at``: start, end, piece or byte fallback."""
        start, end, number = self.lexicon.matches(data, at, stop)
        spelt = np.zeros(len(data) + 1, bool)
        spelt[start[end == after[start]]] = True
        bare = at[~spelt[at]]
        return np.concatenate([start, bare]), np.concatenate([end, after[bare]]), np.concatenate([self.piece[number], np.full(len(bare), _FALLBACK, np.int32)])

    def arc_weights(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.weight[piece], self.fallback_weight)

    def paths(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the shortest paths of chunks data[first[k]:first[k + 1]], one after another, and where each chunk's begin."""
        n = len(data)
        starts, first = np.flatnonzero((data & 0xC0) != 0x80).astype(np.int32), first.astype(np.int32)
        after = np.full(n + 1, n, np.int32)
        after[starts[:-1]] = starts[1:]
        size = np.diff(first)
        after[starts] = np.minimum(after[starts], np.repeat(first[1:], size)[starts])
        via, back = np.full(n + 1, _NONE, np.int32), np.zeros(n + 1, np.int32)
        chunk = np.repeat(np.arange(len(size), dtype=np.int32), size)  # of each byte
        self._short(data, first, chunk, starts[(size <= LONG)[chunk[starts]]], after, via, back)
        for k in np.flatnonzero(size > LONG).tolist():
            self._long(data, int(first[k]), int(first[k + 1]), starts, after, via, back)
        used = np.zeros(n + 1, bool)  # ends of arcs on the best paths; a chunk's end is on its path
        at, begin = first[1:][size > 0], first[:-1][size > 0]
        long = size[size > 0] > LONG
        for e, b in zip(at[long].tolist(), begin[long].tolist(), strict=True):
            while e > b:
                used[e] = True
                e = int(back[e])
        at, begin = at[~long], begin[~long]
        while len(at):
            used[at] = True
            at = back[at]
            more = at > begin
            at, begin = at[more], begin[more]
        end = np.flatnonzero(used)
        piece, chunk = via[end], chunk[end - 1]
        bare = piece == _FALLBACK
        if self.byte_id[0] < 0:  # unknown characters side by side are one
            joined = np.zeros(len(end), bool)
            joined[1:] = bare[1:] & bare[:-1] & (chunk[1:] == chunk[:-1])
            piece, chunk = np.where(bare, self.unknown, piece)[~joined], chunk[~joined]
            return piece, np.searchsorted(chunk, np.arange(len(first)))
        count = np.where(bare, end - back[end], 1)
        flat, bounds = np.repeat(piece, count), np.concatenate([[0], np.cumsum(count)])
        hole = np.flatnonzero(np.repeat(bare, count))
        if len(hole):
            whole = np.repeat(np.arange(len(end)), count)[hole]
            flat[hole] = self.byte_id[data[back[end[whole]] + hole - bounds[whole]]]
        return flat, bounds[np.searchsorted(chunk, np.arange(len(first)))]

    def _short(self, data, first, chunk, at, after, via, back) -> None:
        """Shortest paths of all short chunks, position by position."""
        if not len(at):
            return
        start, end, piece = self.lattice(data, at, first[chunk[at] + 1], after)
        place = (start - first[chunk[start]]).astype(np.uint8)
        order = np.argsort(place, kind="stable")  # by counting
        start, end, piece = start[order], end[order], piece[order]
        edge = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
        cost = np.full(len(data) + 1, np.inf)
        begins = np.zeros(len(data) + 1, bool)  # a chunk's begin may be the end of the one before
        begins[first[chunk[at]]] = True
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if a == b:
                continue
            s, e, p = start[a:b], end[a:b], piece[a:b]
            c = np.where(begins[s], 0.0, cost[s]) + self.arc_weights(p)
            better = c < cost[e]
            if self.merges is not None:
                better = np.flatnonzero(better)
                real = p[better] >= 0
                ask = better[real]
                ok = np.ones(len(better), bool)
                ok[real] = self.merges.follows(np.where(begins[s[ask]], _NONE, via[s[ask]]), p[ask])
                better = better[ok]
            s, e, p, c = s[better], e[better], p[better], c[better]
            cost[e], via[e], back[e] = c, p, s

    def _long(self, data, begin: int, stop: int, starts, after, via, back) -> None:
        """The shortest path of one long chunk: arcs are made a window at a time, and its states one after another."""
        cost = {begin: 0.0}
        merges, n = self.merges, len(self.surface_first)
        for lo in range(begin, stop, WINDOW):
            hi = min(lo + WINDOW, stop)
            at = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, hi)]
            if not len(at):
                continue
            start, end, piece = self.lattice(data, at, np.full(len(at), stop), after)
            order = np.argsort(start, kind="stable")
            start, end, piece = start[order], end[order], piece[order]
            weight = self.arc_weights(piece).tolist()
            may: dict[int, bool] = {}
            if merges is not None:
                may = self._pairs(data, max(begin, lo - self.lexicon.longest), lo, stop, starts, after, start, end, piece)
            edge = np.searchsorted(start, np.append(at, hi)).tolist()
            ends, numbers = end.tolist(), piece.tolist()
            for i, a, b in zip(at.tolist(), edge[:-1], edge[1:], strict=True):
                here = cost.pop(i, None)
                if here is None:
                    continue
                last = int(via[i]) if i > begin else _NONE
                for x in range(a, b):
                    e, p, c = ends[x], numbers[x], here + weight[x]
                    if c < cost.get(e, np.inf) and (merges is None or p < 0 or (may[last * n + p] if last >= 0 else bool(merges.alone[p]))):
                        cost[e] = c
                        via[e], back[e] = p, i

    def _pairs(self, data, lo: int, mid: int, stop: int, starts, after, start, end, piece) -> dict[int, bool]:
        """Arcs of the constraint between neighbouring pieces of a window's lattice, with the ``longest`` bytes before it."""
        at = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, mid)]
        _, e0, p0 = self.lattice(data, at, np.full(len(at), stop), after) if len(at) else (None, end[:0], piece[:0])
        e0, p0 = np.concatenate([e0, end]), np.concatenate([p0, piece])
        e0, p0 = e0[p0 >= 0], p0[p0 >= 0]
        s1, p1 = start[piece >= 0], piece[piece >= 0]
        a, b = np.searchsorted(s1, e0, "left"), np.searchsorted(s1, e0, "right")
        second, _ = ragged(np.arange(len(s1)), a, b - a)
        key = np.unique(np.repeat(p0, b - a).astype(np.int64) * len(self.surface_first) + p1[second])
        ok = self.merges.follows((key // len(self.surface_first)).astype(np.int32), (key % len(self.surface_first)).astype(np.int32))
        return dict(zip(key.tolist(), ok.tolist(), strict=True))

    def encode_run(self, run: K.Run) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a run, and where each row's begin. Empty rows have none."""
        data, offsets = self.normaliser.apply(run.data, run.offsets)
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        begins = np.zeros(n, bool)
        if self.cuts:
            begins[1:] = (data[1:] == 32) & (data[:-1] != 32)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        edges = np.append(np.flatnonzero(begins), n)
        ids, counts, lo = [], [], 0
        while lo < len(edges) - 1:
            hi = min(max(lo + 1, int(np.searchsorted(edges, edges[lo] + SLICE, "right")) - 1), len(edges) - 1)
            part, edge = data[edges[lo] : edges[hi]], edges[lo : hi + 1] - edges[lo]
            if len(edge) == 2:
                flat, bounds = self.paths(part, edge)
                inverse = np.zeros(1, np.int64)
            else:
                _, index, inverse = np.unique(K.segment_hashes(part, edge[:-1], edge[1:]), return_index=True, return_inverse=True)
                flat, bounds = self.paths(*ragged(part, edge[index], np.diff(edge)[index]))
            out, bounds = ragged(flat, bounds[inverse], np.diff(bounds)[inverse])
            ids.append(out)
            counts.append(np.diff(bounds))
            lo = hi
        total = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return np.concatenate(ids), total[np.searchsorted(edges[:-1], offsets)]

    def decode_run(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that the ids write, and where each row's begin, without the dummy prefix."""
        flat, bounds = ragged(self.surface_flat, self.surface_first[ids], self.surface_first[ids + 1] - self.surface_first[ids])
        offsets = bounds[first]
        if not self.normaliser.prefix:
            return flat, offsets
        drop = offsets[:-1][np.diff(offsets) > 0]
        drop = drop[flat[drop] == 32]
        keep = np.ones(len(flat), bool)
        keep[drop] = False
        return flat[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def ragged(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[begin[k]:begin[k] + count[k]] for all k, one after another, and where each begins."""
    bounds = np.concatenate([[0], np.cumsum(count)])
    return flat[np.repeat(begin - bounds[:-1], count) + np.arange(bounds[-1])], bounds


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, model_file: str | None = None, text_col: str = "text", keep_ids: bool = True, carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all unless given) and ``sp_ids`` array<int>, ``sp_crc32`` long, ``sp_tokens`` long and ``sp_same`` boolean.

    ``sp_ids`` are the ids of the whole text without begin and end marks (left out unless ``keep_ids``), ``sp_crc32``
    the unsigned crc32 of them as little-endian unsigned 32-bit integers, ``sp_same`` whether decoding them gives the
    text back. Null and empty texts have no ids and crc32 0. A U+2581 in a text is the space it stands for, so it alone
    doesn't decode to itself. Rows are encoded one by one, repeated rows alike; very long texts in slices; columns of those
    names are replaced. The model file is read on the driver only.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Machine(model_file or default_model()))
    added = [T.StructField("sp_ids", T.ArrayType(T.IntegerType())), T.StructField("sp_tokens", T.LongType()), T.StructField("sp_crc32", T.LongType()), T.StructField("sp_same", T.BooleanType())][0 if keep_ids else 1 :]
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("sp_ids", "sp_tokens", "sp_crc32", "sp_same")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for run in K.runs(batch.column(text_col), SLICE):
                ids, first = m.encode_run(run)
                back, offsets = m.decode_run(ids, first)
                same = np.diff(offsets) == np.diff(run.offsets)
                if same.all():
                    odd = np.flatnonzero(back != run.data)
                    same[np.unique(np.searchsorted(run.offsets, odd, "right") - 1)] = False
                else:
                    same = np.array([s and bool((back[offsets[r] : offsets[r + 1]] == run.data[run.offsets[r] : run.offsets[r + 1]]).all()) for r, s in enumerate(same)])
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                sums = [crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                new = [pa.array(np.diff(first)), pa.array(sums, pa.int64()), pa.array(same)]
                if keep_ids:
                    new.insert(0, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(run.lo, run.hi - run.lo) for c in kept), *new], [*kept, *(f.name for f in added)])
            K.give_back()

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(K.tidy(apply), T.StructType([docs.schema[c] for c in kept] + added))


def decode(rows: DataFrame, model_file: str | None = None, ids_col: str = "sp_ids") -> DataFrame:
    """All columns of ``rows`` and ``sp_text``: what the ids spell. Null ids give null, no ids the empty text."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(Machine(model_file or default_model()))
    kept = [c for c in rows.columns if c != "sp_text"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = []
            for ids in batch.column(ids_col).to_pylist():
                a = np.array(ids or [], np.int64)
                flat, _ = m.decode_run(a, np.array([0, len(a)]))
                texts.append(None if ids is None else flat.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "sp_text"])

    return rows.select(*kept).mapInArrow(apply, T.StructType([rows.schema[c] for c in kept] + [T.StructField("sp_text", T.StringType())]))


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, keep_ids=False, carry=["doc_id"]).select("doc_id", F.col("sp_tokens").alias("n_tokens"), F.col("sp_crc32").alias("ids_crc32"), F.col("sp_same").alias("round_trip"))
