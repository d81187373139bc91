"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Each code point is mapped to a symbol: its class, with the one or two code points after it folded in where they matter (white
space before a non-space; an apostrophe before s, t, m, d, re, ve or ll). A small automaton over these symbols marks where
pieces begin. Its transition functions generate a monoid of a few dozen functions, so they compose by one table look-up
and the automaton's states come from an associative scan: composed within rows of a matrix, then over rows, then applied.
No regular expression runs. Equal pieces of a chunk are encoded once, from a cache of pair merges; each token keeps its byte offset.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, StructField, StructType

from lexispark.llm import textbytes as T
from lexispark.llm.common import numbered, quoted

# code point classes
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
# symbols: the classes of what isn't white space, then white space and apostrophes by what follows
SPACE_LAST, WHITE_LAST, WHITE_MORE, SHORT, LONG = 3, 4, 5, 6, 7
N_SYMBOLS = 8
# states: which piece is open
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8
#: The code points that the pattern's \s stands for (Unicode White_Space).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: First and last code points of letters and numbers that Unicode 16 added, which the tokenizer's pattern knows and Python's tables may not.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1),
    (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
LARGEST_VOCABULARY = 64 << 20
_ROW = 1024
NO_TOKEN = 1 << 30
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_LONG_PIECE, _CACHED = 64, 300_000


@cache
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode general categories."""
    of = {"L": LETTER, "N": NUMBER}
    out = np.array([of.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)], np.uint8)
    for kind, new in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS)):
        for first, last in new:
            out[first : last + 1] = kind
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a symbol, and whether a piece begins with it."""
    if symbol == LETTER and state in (ONE_LEFT, TWO_LEFT):
        return (NONE if state == ONE_LEFT else ONE_LEFT), False
    if symbol in (LETTER, NUMBER, OTHER):
        own = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[symbol]
        return own, state not in (own, AFTER_SPACE)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == SPACE_LAST:
        return AFTER_SPACE, True
    if symbol == WHITE_LAST:
        return NONE, True
    return IN_WHITE, state != IN_WHITE


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each symbol's function (a second set for the first symbol of a text), all functions, their products, next states and piece starts by (symbol, state)."""
    nexts = np.array([[_step(q, s)[0] for q in range(N_STATES)] for s in range(N_SYMBOLS)], np.uint8)
    starts = np.array([[_step(q, s)[1] for q in range(N_STATES)] for s in range(N_SYMBOLS)], bool)
    nexts = np.concatenate([nexts, np.repeat(nexts[:, :1], N_STATES, axis=1)])
    starts = np.concatenate([starts, np.ones_like(starts)])
    known: dict[tuple, int] = {tuple(range(N_STATES)): 0}
    for f in nexts:
        known.setdefault(tuple(f.tolist()), len(known))
    todo = list(known)
    for f in todo:
        for g in nexts:
            h = tuple(int(g[q]) for q in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    if len(known) > 256:
        raise AssertionError("the transition monoid outgrew a byte")
    functions = np.array(list(known), np.uint8)
    products = np.array([[known[tuple(int(g[q]) for q in f)] for g in functions] for f in functions], np.uint8)
    return np.array([known[tuple(f.tolist())] for f in nexts], np.uint8), functions, products, nexts, starts


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pieces begin. points: code points of some texts, one after the other; first: the places where a text begins."""
    n = len(points)
    kind = classes()[points]
    begins = np.zeros(n + 1, bool)
    begins[first] = True
    begins[n] = True
    white = kind >= SPACE
    follows = np.zeros(n, bool)
    follows[:-1] = ~white[1:]
    follows &= ~begins[1:]
    symbol = kind.copy()
    symbol[white] = WHITE_MORE
    symbol[white & follows] = WHITE_LAST
    symbol[(kind == SPACE) & follows] = SPACE_LAST
    at = np.flatnonzero(points == 39)
    if len(at):
        one, two = (np.where(at + d < n, points[np.minimum(at + d, n - 1)], 0) for d in (1, 2))
        one[begins[np.minimum(at + 1, n)]] = 0
        two[(one == 0) | begins[np.minimum(at + 2, n)]] = 0
        symbol[at[np.isin(one, [115, 116, 109, 100])]] = SHORT
        symbol[at[((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)]] = LONG
    symbol[begins[:-1]] += N_SYMBOLS
    of_symbol, functions, products, nexts, starts = _monoid()
    rows = -(-n // _ROW)
    padded = np.zeros(rows * _ROW, np.uint8)
    padded[:n] = symbol
    by_column = np.ascontiguousarray(padded.reshape(rows, _ROW).T)
    whole = np.zeros(rows, np.uint8)
    for column in by_column:
        whole = products[whole, of_symbol[column]]
    state, before = NONE, np.empty(rows, np.uint8)
    for i, f in enumerate(whole.tolist()):
        before[i] = state
        state = functions[f, state]
    out = np.empty((_ROW, rows), bool)
    now = before
    for i, column in enumerate(by_column):
        out[i] = starts[column, now]
        now = nexts[column, now]
    return np.flatnonzero(np.ascontiguousarray(out.T).ravel()[:n])


class Vocabulary:
    """Ranks of byte strings; every byte needs one."""

    def __init__(self, file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines()) if a}
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for t, i in self.ranks.items():
            tokens[i] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.of_byte = np.array([self.ranks[bytes([i])] for i in range(256)])
        self.pairs: dict[int, int] = {}
        get = self.ranks.get
        for t, i in self.ranks.items():
            for k in range(1, len(t)):
                if (a := get(t[:k])) is not None and (b := get(t[k:])) is not None:
                    self.pairs[a << 24 | b] = i
        self.cache: dict[bytes, tuple[int, ...]] = {}
        keys, values = (np.array(x, np.int64) for x in (list(self.pairs), list(self.pairs.values())))
        # a hash table with four to eight slots for a pair
        bits = max(4, int(4 * len(keys)).bit_length())
        self.last_slot, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.slot_keys, self.slot_values = np.full(1 << bits, -1), np.full(1 << bits, NO_TOKEN)
        slot = (keys.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        while len(keys):
            _, one = np.unique(slot, return_index=True)
            one = one[self.slot_values[slot[one]] == NO_TOKEN]
            self.slot_keys[slot[one]], self.slot_values[slot[one]] = keys[one], values[one]
            rest = np.ones(len(keys), bool)
            rest[one] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.last_slot

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that each pair merges to, or NO_TOKEN: probes of a hash table, all pairs at a time."""
        key = a << 24 | b
        slot = (key.astype(np.uint64) * _SPREAD >> self.shift).astype(np.int64)
        out = self.slot_values[slot]
        todo = np.flatnonzero((self.slot_keys[slot] != key) & (out != NO_TOKEN))
        out[todo] = NO_TOKEN
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.last_slot
            held, value = self.slot_keys[slot[todo]], self.slot_values[slot[todo]]
            same = held == key[todo]
            out[todo[same]] = value[same]
            todo = todo[~same & (value != NO_TOKEN)]
        return out

    def merge_many(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[tuple[int, ...]]:
        """The tokens of each piece: the pair of least rank is merged, the leftmost of equals, until none is left; all pieces step together."""
        sizes = stops - starts
        ids = self.of_byte[data[ranges(starts, sizes)]]
        out: list = [None] * len(starts)
        which = np.arange(len(starts))
        joined = np.full(len(ids), NO_TOKEN)
        joined[:-1] = self._pair(ids[:-1], ids[1:])
        joined[np.cumsum(sizes) - 1] = NO_TOKEN
        while len(which):
            first = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(joined, first)
            done = best == NO_TOKEN
            if done.any():
                flat, a = ids.tolist(), first.tolist()
                n = sizes.tolist()
                for i in np.flatnonzero(done).tolist():
                    out[which[i]] = tuple(flat[a[i] : a[i] + n[i]])
                stay = np.repeat(~done, sizes)
                ids, joined, which, sizes, best = ids[stay], joined[stay], which[~done], sizes[~done], best[~done]
                if not len(which):
                    break
                first = np.cumsum(sizes) - sizes
            hit = np.flatnonzero(joined == np.repeat(best, sizes))
            at = hit[np.searchsorted(hit, first)]
            ids[at] = best
            last = first + sizes - 1
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            follows = at + 2
            has = follows <= last
            joined[at] = NO_TOKEN
            joined[at[has]] = self._pair(best[has], ids[follows[has]])
            has = at > first
            joined[at[has] - 1] = self._pair(ids[at[has] - 1], best[has])
            ids, joined, sizes = ids[keep], joined[keep], sizes - 1
        return out

    def merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same for one long piece, with a heap and a linked list: n log n in its length."""
        return self._merge_long(self.of_byte[np.frombuffer(piece, np.uint8)].tolist())

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        n, pairs = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs(ids[i] << 24 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs(rank << 24 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := pairs(ids[h] << 24 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return tuple(x for x in ids if x >= 0)

    def encode(self, chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of a chunk's texts one after the other (unsigned 32 bits), and where each text's begin, with the end."""
        data = chunk.data
        if not len(data):
            return np.empty(0, np.uint32), np.zeros(len(chunk) + 1, np.int64)
        filled = chunk.ends > chunk.starts
        if (data < 0x80).all():
            at = piece_starts(data, chunk.starts[filled])
        else:
            points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            at = begins[piece_starts(points, np.searchsorted(begins, chunk.starts[filled]))]
        stops = np.append(at[1:], len(data))
        one, of, often = distinct_pieces(data, at, stops)
        first, stop = at[one], stops[one]
        raw, known, ranks = data.tobytes(), self.cache.get, self.ranks.get
        pieces = [raw[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
        merged = [(whole,) if (whole := ranks(x)) is not None else known(x) for x in pieces]
        new = np.array([i for i, ids in enumerate(merged) if ids is None], np.int64)
        long = (stop[new] - first[new]) > _LONG_PIECE
        for i in new[long].tolist():
            merged[i] = self.merge_long(pieces[i])
        new = new[~long]
        if len(self.cache) > _CACHED:
            self.cache.clear()
        for i, ids, n in zip(new.tolist(), self.merge_many(data, first[new], stop[new]), often[new].tolist(), strict=True):
            merged[i] = ids
            if n > 1:
                self.cache[pieces[i]] = ids
        sizes = np.fromiter(map(len, merged), np.int64, len(merged))
        flat = np.fromiter(chain.from_iterable(merged), np.uint32, int(sizes.sum()))
        ids = flat[ranges((np.cumsum(sizes) - sizes)[of], sizes[of])]
        ends = np.concatenate([[0], np.cumsum(sizes[of])])
        return ids, ends[np.append(np.searchsorted(at, chunk.starts), len(at))]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that tokens stand for."""
        ids = ids.astype(np.int64)
        return self.bytes[ranges(self.offsets[ids], self.lengths[ids])]


def distinct_pieces(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct pieces: where each first occurs, which of them every piece is, and how often each occurs. Grouped by hash; their bytes are then compared."""
    _, one, of, often = np.unique(T.span_hashes(data, starts, stops, spaces=True), return_index=True, return_inverse=True, return_counts=True)
    sizes, first = stops - starts, one[of]
    again = np.flatnonzero(first != np.arange(len(starts)))
    other = first[again]
    if (sizes[again] == sizes[other]).all() and not T.differing(data, starts[again], starts[other], sizes[again]).any():
        return one, of, often
    # a collision: the bytes themselves decide
    raw, seen = data.tobytes(), {}
    of = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    _, one, often = np.unique(of, return_index=True, return_counts=True)
    return one, of, often


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., sizes[0] of them, then the same for each other start."""
    total = int(sizes.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


_vocabularies: dict[int, Vocabulary] = {}


def _shared(spark: SparkSession, path: str):
    """The rank file as a broadcast, after a check of its size."""
    with open(path, "rb") as f:
        file = f.read(LARGEST_VOCABULARY + 1)
    if len(file) > LARGEST_VOCABULARY:
        raise ValueError(f"{path} has over {LARGEST_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(file)


def _vocabulary(shared) -> Vocabulary:
    if (key := hash(shared.value)) not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(shared.value)
    return _vocabularies[key]


def encode(docs: DataFrame, path: str, text_col: str = "text", verified: str = "") -> DataFrame:
    """docs with two more columns: bpe_ids (array of int) and bpe_offsets (the byte of the text at which each token begins).

    With a name in verified, a third column of that name says whether the ids decode to the text. Columns of docs of those names are
    replaced. Null counts as the empty text, which has no tokens. Rows stay as they are.
    """
    shared = _shared(docs.sparkSession, path)
    own = [c for c in docs.columns if c.lower() not in ("bpe_ids", "bpe_offsets", verified.lower())]
    more = [StructField(verified, BooleanType())] if verified else []
    docs = numbered(docs.select(*[quoted(c) for c in own]))
    at, schema = own.index(text_col), StructType([*docs.schema.fields, StructField("bpe_ids", ArrayType(IntegerType())), StructField("bpe_offsets", ArrayType(IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            for chunk in T.chunks(batch.column(at)):
                ids, ends = v.encode(chunk)
                sizes = v.lengths[ids.astype(np.int64)]
                begin = np.cumsum(sizes) - sizes
                begin = begin - np.repeat(chunk.starts, np.diff(ends))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, begin)]
                if verified:
                    lists.append(pa.array(_same(chunk, v.decode(ids), np.concatenate([[0], np.cumsum(sizes)])[ends])))
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([*part.columns, *lists], [*part.schema.names, "bpe_ids", "bpe_offsets", *[f.name for f in more]])

    return docs.mapInArrow(run, schema).toDF(*own, "bpe_ids", "bpe_offsets", *[f.name for f in more])


def _same(chunk: T.Chunk, back: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Whether each text of a chunk equals its part, between cuts, of the bytes in back."""
    same = (np.diff(cuts) == chunk.ends - chunk.starts) & (cuts[:-1] == chunk.starts)
    n = min(len(back), len(chunk.data))
    wrong = np.concatenate([[0], np.cumsum(back[:n] != chunk.data[:n])])
    return same & (wrong[np.minimum(chunk.ends, n)] == wrong[np.minimum(chunk.starts, n)])


def decode(tokens: DataFrame, path: str, ids_col: str = "bpe_ids", to: str = "decoded") -> DataFrame:
    """tokens with one more column: the bytes that the ids stand for (binary; null for null)."""
    shared = _shared(tokens.sparkSession, path)
    own = [c for c in tokens.columns if c.lower() != to.lower()]
    tokens = numbered(tokens.select(*[quoted(c) for c in own]))
    at = own.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                column = part.column(at)
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ids = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                raw = v.decode(ids).tobytes()
                cuts = np.concatenate([[0], np.cumsum(v.lengths[ids])])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
                out = [raw[a:b] if ok else None for a, b, ok in zip(cuts, cuts[1:], column.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, to])

    return tokens.mapInArrow(run, StructType([*tokens.schema.fields, StructField(to, BinaryType())])).toDF(*own, to)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32 bits), decoded_sha256 (of the bytes decoded from the ids).

    Null counts as the empty text. Ids of documents may be null or repeat. Other columns are left out. No shuffle.
    """
    shared = _shared(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared)
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                ids, ends = v.encode(chunk)
                raw, back = ids.astype("<u4").tobytes(), v.decode(ids).tobytes()
                sizes = np.concatenate([[0], np.cumsum(v.lengths[ids.astype(np.int64)])])[ends].tolist()
                cuts = ends.tolist()
                of_ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
                of_text = [hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(sizes, sizes[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(np.diff(ends)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
