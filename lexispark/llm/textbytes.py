"""Vectorised views of texts as UTF-8 bytes, for operators that run in Arrow batches.

A batch of texts is cut into chunks of bounded size (a longer text is a chunk of its own), so the working memory of a
worker is a constant times the chunk, whatever the batch holds. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~_SPACE


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values for a seed, alike on every worker."""
    base = np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return mix(mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + base) + base)


_BYTE_VALUES = randoms(256, 11)
_BYTE_VALUES[_SPACE] = 0
_BYTE_VALUES_LOWER = _BYTE_VALUES.copy()
_BYTE_VALUES_LOWER[65:91] = _BYTE_VALUES[97:123]
_LOW = 4096
_MULTIPLIERS = randoms(_LOW, 12) | np.uint64(1)


def _multipliers(at: np.ndarray, longest: int) -> np.ndarray:
    """A random odd number for each place in a span, alike in every chunk. Powers of one number would let texts of a regular build collide modulo 2**64."""
    if longest <= _LOW:
        return _MULTIPLIERS[at]
    out = _MULTIPLIERS[np.minimum(at, _LOW - 1)]
    far = np.flatnonzero(at >= _LOW)
    out[far] = mix(mix(at[far].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) + np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
    return out


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Which spans of so many bytes, at least one each, that begin at a and at b differ in a byte; compared in blocks, so that memory is bounded."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(sizes)
    i = 0
    while i < len(a):
        begin = int(ends[i] - sizes[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + block, "right")))
        n, first = sizes[i:j], ends[i:j] - sizes[i:j] - begin
        inside = np.arange(int(ends[j - 1]) - begin) - np.repeat(first, n)
        wrong = data[np.repeat(a[i:j], n) + inside] != data[np.repeat(b[i:j], n) + inside]
        out[i:j] = np.logical_or.reduceat(wrong, first)
        i = j
    return out


@dataclass
class Chunk:
    """Some consecutive texts: their bytes, and where each begins and ends in them; first is the first text's place."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.starts)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column into chunks of at most limit bytes, or of one text."""
    texts = pc.fill_null(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield Chunk(data[at[i] : at[j]], at[i:j] - at[i], at[i + 1 : j + 1] - at[i], i)
        i = j


@dataclass
class Words:
    """The words of a chunk (runs of bytes other than 0x20 and 0x09 to 0x0D), none across two texts.

    starts, ends: byte places; first, last: of each text, its range of words; hashes: 64 bits for each word.
    """

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hashes: np.ndarray | None


def words(chunk: Chunk, lower: bool = False, hashed: bool = True) -> Words:
    data, n = chunk.data, len(chunk.data)
    is_word = NOT_SPACE[data]
    begins, stops = is_word.copy(), is_word.copy()
    if n:
        begins[1:] &= ~is_word[:-1]
        stops[:-1] &= ~is_word[1:]
        own = chunk.starts[chunk.ends > chunk.starts]
        begins[own] = is_word[own]
        own = chunk.ends[chunk.ends > chunk.starts] - 1
        stops[own] = is_word[own]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first, last = np.searchsorted(starts, chunk.starts), np.searchsorted(starts, chunk.ends)
    hashes = None
    if hashed:
        hashes = np.empty(0, np.uint64)
        if len(starts):
            hashes = span_hashes(data, starts, ends, lower)
    return Words(starts, ends, first, last, hashes)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, spaces: bool = False) -> np.ndarray:
    """64-bit multilinear hashes of disjoint ascending spans of data; white space outside or inside counts for nothing unless spaces."""
    table = _BYTE_VALUES_LOWER if lower else _BYTE_VALUES
    if spaces:
        table = table.copy()
        table[_SPACE] = randoms(6, 13)
    begin = int(starts[0])
    gaps = np.diff(np.append(starts, int(ends[-1])))
    at = np.arange(begin, int(ends[-1])) - np.repeat(starts, gaps)
    longest = int(gaps.max())
    value = table[data[begin : int(ends[-1])]]
    if spaces:
        value[at >= np.repeat(ends - starts, gaps)] = 0
    value *= _multipliers(at, longest)
    return mix(np.add.reduceat(value, starts - begin) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive values; the window at i covers i to i+k-1."""
    if len(hashes) < k:
        return np.empty(0, np.uint64)
    factors = randoms(k, 17) | np.uint64(1)
    out = hashes[: len(hashes) - k + 1] * factors[0]
    for j in range(1, k):
        out += hashes[j : len(hashes) - k + 1 + j] * factors[j]
    return mix(out + np.uint64(k))


def windows_at(hashes: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """As windows(), only for those that begin at the given places."""
    factors = randoms(k, 17) | np.uint64(1)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += hashes[at + j] * factors[j]
    return mix(out + np.uint64(k))
