"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A text is cut into slices as the byte-level BPE pattern below would cut it, but without a
regular expression. Code points become classes; classes become the transition functions of
a small automaton; functions are composed by an associative scan over doubling distances
until every one is constant, which gives the state before every character and so the
boundaries. All of a block of texts is handled at once.

The pattern, in order: 's 't 're 've 'm 'll 'd; letters, numbers or other characters, each
with one optional space before; white space not followed by other characters; white space.

Slices go through pair merging by rank, lowest first and leftmost on ties: all slices of a
block that aren't in the cache at once, a merge in each slice a round. Results are kept in
a cache of bounded size. Token ids come with byte offsets; the decoder puts each token's bytes at its
offset, and offsets that don't fit the ids are an error.

Edge cases: null counts as the empty text, which has no ids and decodes to no bytes; very long
texts are encoded whole, and one slice of any length is merged in n log n steps; an unknown id fails the
decoder; repeated rows are encoded alike; null ids and ties play no part; an empty table gives an empty result; extra
columns are carried, whatever their names, and replaced where they clash with results (ids, offsets, decoded).
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .npbytes import blocks, tidy

#: Bytes of text handled at once.
BLOCK = 1 << 19
#: Slices whose ids a worker remembers.
CACHE = 150_000
#: No rank.
NONE = 1 << 40

#: States: nothing open, letters, numbers, others, a space that waits, one or two letters of a contraction to come, a contraction closed, white space.
FRESH, LETTERS, NUMBERS, OTHERS, WAITING, ONE, TWO, CLOSED, BLANK = range(9)
#: Symbols: letter, number, other, apostrophe before a contraction of one or two letters, space before a non-space, other such white space, white space inside a run or at the end.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE, BREAK, WHITE = range(8)


# Letters and numbers that Unicode 16.0 has and the 15.1 tables of this Python lack, and White_Space.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
BLANKS = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))


def _step(state: int, symbol: int) -> int:
    if symbol == LETTER:
        return {TWO: ONE, ONE: CLOSED}.get(state, LETTERS)
    if symbol in (APOS1, APOS2):
        return OTHERS if state in (OTHERS, WAITING) else ONE if symbol == APOS1 else TWO
    return {NUMBER: NUMBERS, OTHER: OTHERS, SPACE: WAITING, BREAK: FRESH, WHITE: BLANK}[symbol]


def _begins(state: int, symbol: int) -> bool:
    """Whether a slice begins at ``symbol``."""
    if symbol == LETTER:
        return state not in (LETTERS, WAITING, ONE, TWO)
    if symbol == NUMBER:
        return state not in (NUMBERS, WAITING)
    if symbol in (OTHER, APOS1, APOS2):
        return state not in (OTHERS, WAITING)
    return symbol != WHITE or state != BLANK


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each symbol [first in text, symbol], code of a after b, the state a constant code gives or -1)."""
    functions: dict[tuple[int, ...], int] = {}
    symbols = np.zeros((2, 8), np.uint8)
    for s in range(8):
        own = tuple(_step(q, s) for q in range(9))
        symbols[0, s] = functions.setdefault(own, len(functions))
        symbols[1, s] = functions.setdefault((own[FRESH],) * 9, len(functions))
    while True:  # close under composition
        known = list(functions)
        for f in known:
            for g in known:
                functions.setdefault(tuple(g[q] for q in f), len(functions))
        if len(functions) == len(known):
            break
    n = len(functions)
    after = np.zeros((n, n), np.uint8)
    for f, i in functions.items():
        for g, j in functions.items():
            after[i, j] = functions[tuple(g[q] for q in f)]
    constant = np.array([f[0] if len(set(f)) == 1 else -1 for f in functions], np.int8)
    return symbols, after, constant


SYMBOLS, AFTER, CONSTANT = _monoid()
BEGINS = np.array([[_begins(q, s) for s in range(8)] for q in range(9)])


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in chain(range(0xD800), range(0xE000, sys.maxunicode + 1)):
        out[c] = {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0)
    for ranges, k in ((NEW_LETTERS, 1), (NEW_NUMBERS, 2), (BLANKS, 3)):
        for first, last in ranges:
            out[first : last + 1] = k
    return out


def boundaries(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which slices of the texts begin, and the end of the data."""
    if not len(data):
        return np.zeros(1, np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets)] = True
    kind = classes()[points]
    white = kind == 3
    symbol = np.array([OTHER, LETTER, NUMBER, WHITE], np.uint8)[kind]
    followed = np.zeros(n, bool)
    followed[:-1] = ~white[1:] & ~first[1:-1]
    edge = white & followed
    symbol[edge] = np.where(points[edge] == 32, SPACE, BREAK)
    apos = np.flatnonzero(points == 39)
    if len(apos):
        padded = np.concatenate((points, np.zeros(2, np.uint32)))
        ended = np.concatenate((first, np.ones(2, bool)))
        a = np.where(ended[apos + 1], 0, padded[apos + 1])
        b = np.where(ended[apos + 1] | ended[apos + 2], 0, padded[apos + 2])
        symbol[apos[np.isin(a, [ord(c) for c in "stmd"])]] = APOS1
        two = np.zeros(len(apos), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        symbol[apos[two]] = APOS2
    code, reach = SYMBOLS[first[:-1].astype(np.uint8), symbol], 1
    while (CONSTANT[code] < 0).any():
        code[reach:] = AFTER[code[:-reach], code[reach:]]
        reach *= 2
    state = np.empty(n, np.int8)
    state[0] = FRESH
    state[1:] = CONSTANT[code[:-1]]
    state[first[:-1]] = FRESH
    return np.append(at[BEGINS[state, symbol] | first[:-1]], len(data))


class Codec:
    """Ranks of byte strings, as in a rank file (base64 and a number a line)."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        size = max(self.ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        for token, rank in self.ranks.items():
            self.length[rank] = len(token)
        ordered = sorted(self.ranks.items(), key=lambda x: x[1])
        self.bytes = np.frombuffer(b"".join(t for t, _ in ordered), np.uint8)
        self.start = np.concatenate(([0], np.cumsum(np.maximum(self.length, 0))))[:-1]
        self.cache: dict[bytes, bytes] = {}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self._index_pairs()

    def _index_pairs(self) -> None:
        """An open hash table from pairs of ids to the rank of their concatenation."""
        get, keys, values = self.ranks.get, [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = get(token[:k]), get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.slots = np.uint64(64 - max(10, (3 * len(keys)).bit_length()))
        self.pair_keys = np.full((1 << (64 - int(self.slots))) + 64, -1, np.int64)
        self.pair_ranks = np.full(len(self.pair_keys), NONE, np.int64)
        left, ranks = np.array(keys, np.int64), np.array(values, np.int64)
        at = self._slot(left)
        while len(left):  # the first to claim a free slot gets it, the others move on
            free = self.pair_keys[at] == -1
            self.pair_keys[at[free]] = left[free]
            self.pair_ranks[at[free]] = ranks[free]
            lost = self.pair_keys[at] != left
            left, ranks, at = left[lost], ranks[lost], at[lost] + 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.slots).astype(np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't make a token."""
        keys = a << 32 | b
        at = self._slot(keys)
        out, found = self.pair_ranks[at], self.pair_keys[at]
        wait = np.flatnonzero((found != keys) & (found != -1))
        out[found != keys] = NONE
        step = 1
        while len(wait):
            place = at[wait] + step
            found = self.pair_keys[place]
            hit = found == keys[wait]
            out[wait[hit]] = self.pair_ranks[place[hit]]
            wait = wait[~hit & (found != -1)]
            step += 1
        return out

    def merge_all(self, pieces: list[bytes]) -> None:
        """Put many slices' ids into the cache: a round merges the best pair of every slice left."""
        cache, rest = self.cache, []
        for p in pieces:
            if (rank := self.ranks.get(p)) is not None:
                cache[p] = rank.to_bytes(4, sys.byteorder)
            elif len(p) > 64:
                cache[p] = array("i", self._merge_long(p)).tobytes()
            else:
                rest.append(p)
        if not rest:
            return
        ids = self.single[np.frombuffer(b"".join(rest), np.uint8)]
        piece = np.repeat(np.arange(len(rest)), [len(p) for p in rest])
        rank = np.full(len(ids), NONE, np.int64)
        inner = np.flatnonzero(piece[1:] == piece[:-1])
        rank[inner] = self.pair_rank(ids[inner], ids[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            start = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, len(ids))))
            over = best == NONE
            if over.any():
                done.append((piece[over], ids[over]))
                ids, piece, rank, best = ids[~over], piece[~over], rank[~over], best[~over]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate(([True], piece[at][1:] != piece[at][:-1]))]
            ids[at] = rank[at]
            stay = np.ones(len(ids), bool)
            stay[at + 1] = False
            at -= np.arange(len(at))
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
            rank[at] = NONE
            after = at[(at + 1 < len(ids))]
            after = after[piece[after + 1] == piece[after]]
            rank[after] = self.pair_rank(ids[after], ids[after + 1])
            before = at[at > 0] - 1
            before = before[piece[before] == piece[before + 1]]
            rank[before] = self.pair_rank(ids[before], ids[before + 1])
        piece, ids = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(piece, kind="stable")
        raw = ids[order].astype(np.int32).tobytes()
        ends = np.cumsum(np.bincount(piece, minlength=len(rest))) * 4
        last = 0
        for p, end in zip(rest, ends.tolist(), strict=True):
            cache[p] = raw[last:end]
            last = end

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one long slice, with a heap and a linked list."""
        n, get = len(piece), self.ranks.get
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the end)."""
        cut = boundaries(data, offsets)
        raw, marks = data.tobytes(), cut.tolist()
        pieces = [raw[a:b] for a, b in zip(marks, marks[1:])]  # noqa: B905
        cache = self.cache
        distinct = set(pieces)
        self.merge_all(list(distinct.difference(cache)))
        found = list(map(cache.__getitem__, pieces))
        if len(cache) > CACHE:  # start anew with what the last block used, if that leaves room
            self.cache = {p: cache[p] for p in distinct} if len(distinct) < CACHE // 2 else {}
        counts = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        ids = np.frombuffer(b"".join(found), np.int32)
        first = np.concatenate(([0], np.cumsum(counts)))[np.searchsorted(cut, offsets)]
        return ids, first

    def offsets(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text."""
        ends = np.cumsum(self.length[ids])
        before = ends - self.length[ids]
        base = np.append(before, ends[-1] if len(ends) else 0)[first[:-1]]
        return (before - np.repeat(base, np.diff(first))).astype(np.int32)

    def decode(self, ids: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
        """The bytes of the ids: each token at its place ``begin``, or one after the other."""
        sizes = self.length[ids]
        if len(sizes) and sizes.min() < 0:
            raise ValueError("an id has no token")
        ends = np.cumsum(sizes)
        if begin is None:
            begin = ends - sizes
        elif not np.array_equal(begin, ends - sizes):
            raise ValueError("offsets don't fit the ids")
        total = int(ends[-1]) if len(ends) else 0
        return self.bytes[np.arange(total) + np.repeat(self.start[ids] - begin, sizes)]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str, kept: list[str], with_offsets: bool):
    tables = unicodedata.unidata_version

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if unicodedata.unidata_version != tables:
            raise RuntimeError(f"an executor's Python has Unicode tables {unicodedata.unidata_version}, the driver's {tables}: they may cut texts differently")
        own = codec(path)
        for batch in batches:
            for begin, end, data, offsets in blocks(batch.column("__text"), BLOCK):
                ids, first = own.encode(data, offsets)
                ends = pa.array(first, pa.int32())
                made, names = [pa.ListArray.from_arrays(ends, pa.array(ids))], ["ids"]
                if with_offsets:
                    made.append(pa.ListArray.from_arrays(ends, pa.array(own.offsets(ids, first))))
                    names.append("offsets")
                rest = batch.slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([*[rest.column(c) for c in kept], *made], [*kept, *names])
        own.cache.clear()

    return tidy(run)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists, places = batch.column("__ids"), batch.column("__offsets")
            at = lists.offsets.to_numpy().astype(np.int64)
            ids = lists.values.to_numpy(zero_copy_only=False)
            where = None if places.null_count else places.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            first, n, base = 0, len(lists), at[0]
            while first < n:
                end = min(n, max(first + 1, int(np.searchsorted(at, at[first] + BLOCK // 4, "right")) - 1))
                own_ids = ids[at[first] : at[end]]
                ends = np.concatenate(([0], np.cumsum(own.length[own_ids])))[at[first : end + 1] - at[first]]
                begin = None if where is None else where[at[first] - base : at[end] - base] + np.repeat(ends[:-1], np.diff(at[first : end + 1]))
                made = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(ends), pa.py_buffer(own.decode(own_ids, begin))])
                yield pa.RecordBatch.from_arrays([*batch.slice(first, end - first).columns, made.cast(pa.binary())], [*batch.schema.names, "__decoded"])
                first = end

    return tidy(run)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep_text: bool = False, with_offsets: bool = True) -> DataFrame:
    """``docs`` (without the text unless ``keep_text``) with ids and the byte offset of each token."""
    whole = common.packed(docs, text_col, nulls=True)
    kept = ["__rest", "__text"] if keep_text else ["__rest"]
    schema = common.with_fields(whole, kept, "ids array<int>" + ", offsets array<int>" * with_offsets)
    made = {"ids": F.col("ids")} | ({"offsets": F.col("offsets")} if with_offsets else {})
    return whole.mapInArrow(_encode(path, kept, with_offsets), schema).select(*common.unpacked(docs, text_col, made, text=F.col("__text") if keep_text else None))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds decoded (binary) from ids and offsets, each token's bytes at its offset; offsets that don't fit are an error.

    Null ids decode to no bytes. Without a column of offsets, tokens follow one another.
    """
    none = F.array().cast("array<int>")
    ids = F.coalesce(F.col("ids").cast("array<int>"), none)
    places = F.coalesce(F.col("offsets").cast("array<int>"), none) if "offsets" in encoded.columns else F.lit(None).cast("array<int>")
    rest = [F.col(f"`{c}`") for c in encoded.columns if c not in ("ids", "offsets", "decoded")]
    whole = encoded.select((F.struct(*rest) if rest else F.lit(None).cast("int")).alias("__row"), ids.alias("__ids"), places.alias("__offsets"))
    out = whole.mapInArrow(_decode(path), common.with_fields(whole, whole.columns, "__decoded binary"))
    made = {"ids": F.col("__ids"), "offsets": F.col("__offsets")}
    return out.select(*[made.get(c, F.col("__row").getField(c)).alias(c) for c in encoded.columns if c != "decoded"], F.col("__decoded").alias("decoded"))
