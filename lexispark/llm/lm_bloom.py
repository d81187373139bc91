"""Language-model scores from a log-frequency Bloom filter.

Word pairs of the training texts are counted over the whole corpus and quantised: level q stands for about base**(q-1) occurrences.
The filter holds the items (pair, 1) to (pair, q), so the level of a pair is how many memberships in a row are found. Workers get the filter as a
broadcast, together with exact counts of single words, and score a word w after v by
    (count(v, w) + strength * p(w)) / (count(v) + strength),     p(w) = (count(w) + 0.1) / (N + 0.1 * (V + 1)).

Counts are gathered in segments by hash: each worker sends a segment's pairs, summed up over a stretch of texts, as one block of bytes, and a
task makes that segment's part of the filter. Broadcast happens only if filter and word counts fit in max_broadcast_bytes;
beyond that the filter stays in its segments: each stretch of texts sends its distinct words and pairs to their segments, one block of bytes for each, the same bits
are probed there, and the answers (one byte for a pair) meet the stretch again. Both ways score by the same function and agree to the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textbytes as T
from lexispark.llm.common import checkpointed

MAX_BROADCAST_BYTES = 256 << 20
#: Bits probed for an item; the filter has PROBES / ln 2 bits for an item, so a probe of an absent one is wrong once in 2**PROBES times.
PROBES = 5
BASE, STRENGTH = 1.5, 20.0
#: Bytes of text that one segment's pairs come from; texts' words that are summed up before they are sent; bytes of the texts that ask together.
SEGMENT_BYTES, STRETCH_WORDS, STRETCH_BYTES = 8 << 20, 1 << 19, 4 << 20
_CHUNK = 1 << 20
END, START = np.uint64(0x9D3A_6E1B_0C57_42F1), np.uint64(0x5B1F_88D2_C04E_937B)
_FIRST, _SECOND = T.randoms(2, 41) | np.uint64(1)
HELD_OUT = 10


def _tokens(chunk: T.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk's texts, each text's followed by END; of the token before each; and where each text's begin, with the end."""
    w = T.words(chunk, lower=True)
    n = w.last - w.first
    cuts = np.concatenate([[0], np.cumsum(n + 1)])
    now = np.empty(cuts[-1], np.uint64)
    last = np.zeros(len(now), bool)
    last[cuts[1:] - 1] = True
    now[last], now[~last] = END, w.hashes
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[cuts[:-1]] = START
    return now, before, cuts


def _pairs(before: np.ndarray, now: np.ndarray) -> np.ndarray:
    return T.mix(before * _FIRST + now * _SECOND)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def level_count(levels: np.ndarray) -> np.ndarray:
    """What a level stands for: the mean of the least and the greatest count in it; 0 for none."""
    least = np.ceil(BASE ** (levels - 1.0) - 1e-9)
    most = np.maximum(least, np.ceil(BASE ** levels.astype(float) - 1e-9) - 1)
    return np.where(levels > 0, (least + most) / 2, 0.0)


def _places(items: np.ndarray, sizes: np.ndarray | int, probes: int) -> Iterator[np.ndarray]:
    """The bits of items in segments of so many bits each, fewer than 2**32: the upper half of a hash is scaled to the size."""
    a = T.mix(items)
    b = T.mix(items + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for i in range(probes):
        yield (((a + np.uint64(i) * b) >> np.uint64(32)) * np.asarray(sizes, np.uint64) >> np.uint64(32)).astype(np.int64)


def _item(pairs: np.ndarray, q: int) -> np.ndarray:
    return pairs + np.uint64(q * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def _segment_bits(pairs: np.ndarray, counts: np.ndarray, probes: int = PROBES) -> bytes:
    levels = level(counts)
    n = 8 * max(8, math.ceil(int(levels.sum()) * probes / math.log(2) / 8))
    bits = np.zeros(n, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        for at in _places(_item(pairs[levels >= q], q), n, probes):
            bits[at] = True
    return np.packbits(bits, bitorder="little").tobytes()


class Filter:
    """All segments' bits one after the other, and how many bytes each has."""

    def __init__(self, bits: bytes, lengths: list[int], probes: int = PROBES):
        self.probes = probes
        self.bytes = np.frombuffer(bits, np.uint8)
        self.sizes = 8 * np.array(lengths, np.uint64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes.astype(np.int64))[:-1]])

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """How many memberships in a row each pair has."""
        out = np.zeros(len(pairs), np.int64)
        at = np.arange(len(pairs))
        segment = _segment(pairs, len(self.sizes))
        q = 1
        while len(at):
            size, begin = self.sizes[segment], self.begins[segment]
            held = np.ones(len(at), bool)
            for place in _places(_item(pairs[at], q), size, self.probes):
                place += begin
                held &= self.bytes[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1
            at, segment = at[held], segment[held]
            out[at] = q
            q += 1
        return out


def _segment(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _training(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("_t")


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.crc32(name.cast("binary")) % HELD_OUT == 0).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))


def _gathered(train: DataFrame, segments: int, probes: int) -> DataFrame:
    """One row for each order (1: words, 2: pairs) and segment: its number of distinct and of all, the words' hashes and counts, the pairs' bits."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            rows = []
            for order in (1, 2):
                own, counts = np.unique(np.concatenate([h[order - 1] for h in held]), return_counts=True)
                cuts = np.searchsorted(_segment(own, segments), np.arange(segments + 1))
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    rows.append((order, s, own[cuts[s] : cuts[s + 1]].tobytes(), counts[cuts[s] : cuts[s + 1]].astype(np.uint32).tobytes()))
            held.clear()
            for i in range(0, len(rows), 64):
                cols = zip(*rows[i : i + 64])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["_order", "_segment", "_hashes", "_counts"])

        n = 0
        for batch in batches:
            for chunk in T.chunks(batch.column(0), _CHUNK):
                now, before, _ = _tokens(chunk)
                held.append((now, _pairs(before, now)))
                n += len(now)
                if n >= STRETCH_WORDS:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by order and segment."""
        key, held = None, []

        def finish() -> pa.RecordBatch:
            hashes = np.concatenate([np.frombuffer(h, np.uint64) for h, _ in held])
            counts = np.concatenate([np.frombuffer(c, np.uint32) for _, c in held])
            by = np.argsort(hashes, kind="stable")
            hashes, counts = hashes[by], counts[by].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            own, sums = hashes[first], np.add.reduceat(counts, first)
            if key[0] == 1:
                row = (own.tobytes(), sums.tobytes(), b"")
            else:
                row = (b"", b"", _segment_bits(own, sums, probes))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, len(own), int(sums.sum()), *row), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["_order", "_segment", "_n", "_total", "_hashes", "_counts", "_bits"])

        for batch in batches:
            for order, segment, h, c in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if held and key != (order, segment):
                    yield finish()
                    held.clear()
                key = (order, segment)
                held.append((h, c))
        if held:
            yield finish()

    sent = train.mapInArrow(emit, "_order int, _segment int, _hashes binary, _counts binary")
    return sent.repartition(min(segments, 1 << 16), "_order", "_segment").sortWithinPartitions("_order", "_segment").mapInArrow(combine, "_order int, _segment int, _n long, _total long, _hashes binary, _counts binary, _bits binary")


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_NAMES = [x.split()[0] for x in RESULT.split(", ")]


@dataclass(frozen=True)
class Totals:
    """Of the training texts: how many, their tokens, what (c + 0.1) is divided by; and the smoothing's strength."""

    texts: int
    tokens: int
    floor: float
    strength: float


def _scored(ids: pa.Array, held_out: pa.Array, cuts: np.ndarray, c: np.ndarray, levels: np.ndarray, t: Totals) -> pa.RecordBatch:
    """The result rows of a chunk: c is each token's count, levels what the filter says of it and the token before."""
    c_before = np.empty_like(c)
    c_before[1:] = c[:-1]
    c_before[cuts[:-1]] = t.texts
    p = (c + 0.1) / t.floor
    together = np.minimum(level_count(levels), c_before)
    model = np.log10((together + t.strength * p) / (c_before + t.strength))
    add = lambda x: np.add.reduceat(x, cuts[:-1])
    n = len(cuts) - 1
    return pa.RecordBatch.from_arrays([ids, held_out, pa.array(np.diff(cuts)), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(n, t.tokens)), pa.array(add(np.log10(p))), pa.array(add(model))], _NAMES)


def _count(known: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The counts of the hashes x, 0 for those that are not among the known ones (ascending)."""
    if not len(known):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, counts[at], 0)


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES, strength: float = STRENGTH, probes: int = PROBES) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (log10, single words), score (log10, the model).

    Training texts are those whose id, as text, has a CRC-32 that HELD_OUT doesn't divide; a null id counts as empty text and is held out. Null and
    empty texts have the end token alone. Rows that repeat an id are texts of their own. Words are told apart by 64-bit hashes. Without training
    texts no word is known and every word has the same probability. Other columns are left out.
    """
    rows = _prepared(docs, id_col, text_col)
    seen = rows.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.octet_length("_t")), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    segments = max(1, -(-seen["bytes"] // SEGMENT_BYTES))
    stats = checkpointed(_gathered(_training(rows), segments, probes))
    sums = stats.agg(
        F.coalesce(F.sum(F.when(F.col("_order") == 1, F.col("_total"))), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("_order") == 1, F.col("_n"))), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.length("_hashes") + F.length("_counts") + F.length("_bits")), F.lit(0)).alias("bytes"),
    ).first()
    totals = Totals(seen["n"], sums["tokens"], sums["tokens"] + 0.1 * (sums["words"] + 1), strength)
    if sums["bytes"] > max_broadcast_bytes:
        return _by_segment(rows, stats, segments, totals, probes)
    return _by_broadcast(rows, stats, segments, totals, probes)


def _by_broadcast(rows: DataFrame, stats: DataFrame, segments: int, totals: Totals, probes: int) -> DataFrame:
    """Scores with the filter and the word counts, whose size has been checked, in every worker."""
    table = stats.select("_order", "_segment", "_hashes", "_counts", "_bits").toArrow()
    # each block is copied to its place once; the words end up in the order of their hashes
    order, segment = (table.column(i).to_numpy() for i in range(2))

    def laid(column: int, of: int) -> tuple[np.ndarray, list[int]]:
        at = np.flatnonzero(order == of)
        at = at[np.argsort(segment[at])]
        lengths = {int(segment[i]): len(table.column(column)[i].as_buffer()) for i in at.tolist()}
        out, begin = np.empty(sum(lengths.values()), np.uint8), 0
        for i in at.tolist():
            block = np.frombuffer(table.column(column)[i].as_buffer(), np.uint8)
            out[begin : begin + len(block)] = block
            begin += len(block)
        return out, [lengths.get(k, 0) for k in range(segments)]

    words, counts, (bits, lengths) = laid(2, 1)[0], laid(3, 1)[0], laid(4, 2)
    del table
    shared = rows.sparkSession.sparkContext.broadcast((words, counts, bits, lengths))
    del words, counts, bits
    made: dict[str, tuple] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "model" not in made:
            w, c, b, lengths = shared.value
            made["model"] = w.view(np.uint64), c.view(np.int64), Filter(b, lengths, probes)
        known, known_counts, held = made["model"]
        for batch in batches:
            for chunk in T.chunks(batch.column(2), _CHUNK):
                now, before, cuts = _tokens(chunk)
                distinct, of = np.unique(now, return_inverse=True)
                c = _count(known, known_counts, distinct)[of]
                part = batch.slice(chunk.first, len(chunk))
                yield _scored(part.column(0), part.column(1), cuts, c, held.levels(_pairs(before, now)), totals)

    return rows.select("doc_id", "held_out", "_t").mapInArrow(run, RESULT)


def _in_stretches(rows: DataFrame) -> DataFrame:
    """rows with _stretch: consecutive rows of a partition, of STRETCH_BYTES of text together or one longer text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for chunk in T.chunks(batch.column(2), STRETCH_BYTES):
                if filled and filled + len(chunk.data) > STRETCH_BYTES:
                    now, filled = now + 1, 0
                filled += len(chunk.data)
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(chunk), now)), *part.columns], ["_stretch", "doc_id", "held_out", "_t"])

    return rows.select("doc_id", "held_out", "_t").mapInArrow(run, "_stretch long, doc_id long, held_out boolean, _t string")


def _asked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens and pairs of some texts, ascending, so that the segments come in order too."""
    words, pairs = [], []
    for chunk in T.chunks(texts, _CHUNK):
        now, before, _ = _tokens(chunk)
        words.append(np.unique(now))
        pairs.append(np.unique(_pairs(before, now)))
    return np.unique(np.concatenate(words)), np.unique(np.concatenate(pairs))


def _by_segment(rows: DataFrame, stats: DataFrame, segments: int, totals: Totals, probes: int) -> DataFrame:
    """Scores with the filter and the word counts in their segments: a stretch's questions go there and the answers come back."""
    texts = checkpointed(_in_stretches(rows))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A stretch's rows are consecutive; each of its segments gets one block for words (1) and one for pairs (2)."""

        def blocks(stretch: int, held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            for order, own in enumerate(_asked(pa.concat_arrays(held)), 1):
                which, first = np.unique(_segment(own, segments), return_index=True)
                cuts = np.append(first, len(own))
                for i in range(0, len(which), 256):
                    some = range(i, min(i + 256, len(which)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([order] * len(some), pa.int32()), pa.array(which[i : i + 256].astype(np.int32)), pa.array([stretch] * len(some), pa.int64()), pa.array([own[cuts[k] : cuts[k + 1]].tobytes() for k in some], pa.binary())],
                        ["_order", "_segment", "_stretch", "_hashes"],
                    )

        stretch, held = None, []
        for batch in batches:
            of = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)] if len(of) else []
            for a, b in zip(edges, edges[1:]):
                if held and of[a] != stretch:
                    yield from blocks(stretch, held)
                    held = []
                stretch = int(of[a])
                held.append(batch.column(1).slice(a, b - a))
        if held:
            yield from blocks(stretch, held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A segment's own row comes first in its task, the questions stream past it."""
        at, known, counts, held = None, np.empty(0, np.uint64), np.empty(0, np.int64), Filter(bytes(8), [8], probes)
        for batch in batches:
            out = []
            for i, (order, segment, stretch) in enumerate(zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)):
                if (order, segment) != at:
                    at, known, counts, held = (order, segment), np.empty(0, np.uint64), np.empty(0, np.int64), Filter(bytes(8), [8], probes)
                hashes = np.frombuffer(batch.column(3)[i].as_py(), np.uint64)
                if stretch is not None:
                    out.append((order, segment, stretch, (_count(known, counts, hashes) if order == 1 else held.levels(hashes).astype(np.uint8)).tobytes()))
                elif order == 1:
                    known, counts = hashes, np.frombuffer(batch.column(4)[i].as_py(), np.int64)
                else:
                    held = Filter(bits := batch.column(5)[i].as_py(), [len(bits)], probes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["_order", "_segment", "_stretch", "_answer"])

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.sort_by([("_order", "ascending"), ("_segment", "ascending")])
        order, blocks = right.column("_order").to_pylist(), right.column("_answer").to_pylist()
        texts = left.column("_t").combine_chunks()
        words, pairs = _asked(texts)
        counts = np.frombuffer(b"".join(x for o, x in zip(order, blocks) if o == 1), np.int64)
        levels = np.frombuffer(b"".join(x for o, x in zip(order, blocks) if o == 2), np.uint8).astype(np.int64)
        out = []
        for chunk in T.chunks(texts, _CHUNK):
            now, before, cuts = _tokens(chunk)
            part = left.slice(chunk.first, len(chunk))
            out.append(_scored(part.column("doc_id").combine_chunks(), part.column("held_out").combine_chunks(), cuts, counts[np.searchsorted(words, now)], levels[np.searchsorted(pairs, _pairs(before, now))], totals))
        return pa.Table.from_batches(out)

    nothing = F.lit(None)
    asked = texts.select("_stretch", "_t").mapInArrow(ask, "_order int, _segment int, _stretch long, _hashes binary")
    own = stats.select("_order", "_segment", nothing.cast("long").alias("_stretch"), "_hashes", "_counts", "_bits")
    both = own.unionByName(asked.withColumns({"_counts": nothing.cast("binary"), "_bits": nothing.cast("binary")}))
    both = both.repartition(min(segments, 1 << 16), "_order", "_segment").sortWithinPartitions("_order", "_segment", F.col("_stretch").asc_nulls_first())
    answers = both.mapInArrow(answer, "_order int, _segment int, _stretch long, _answer binary")
    return texts.groupBy("_stretch").cogroup(answers.groupBy("_stretch")).applyInArrow(score, RESULT)
