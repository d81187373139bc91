"""Quality rules: how much of a text lies inside repeated n-grams and repeated lines.

Rolling hashes of 2 to 10 words are sorted per chunk of texts in numpy; every window whose hash occurs again in the same text
marks its words, and a text's coverage at a length is the share of its word characters that are marked. Lengths 2 to 4 count
the most frequent n-gram only; lengths 5 to 10 count every repeated n-gram; repeated lines are covered likewise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import textbytes as T
from lexispark.llm.common import numbered


@dataclass(frozen=True)
class Limits:
    """A text is rejected if a share is above its limit. The limits are those published for web pages (Rae et al. 2021, Gopher)."""

    top: tuple[tuple[int, float], ...] = ((2, 0.20), (3, 0.18), (4, 0.16))
    repeated: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    lines: float = 0.30
    line_chars: float = 0.20
    least_words: int = 50
    most_repeat_percent: int = 50


_ROLL = T.randoms(1, 32)[0] | np.uint64(1)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_INTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of values[first:last] for each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[last] - total[first]


def _again(keys: np.ndarray) -> np.ndarray:
    """The places of keys that occur more than once, ascending. One sort; the few repeated values are then looked up behind a bitmap."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.empty(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(twice & np.uint64(0xFFFF)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(keys & np.uint64(0xFFFF)).astype(np.int64)])
    found = np.searchsorted(twice, keys[at])
    return at[twice[np.minimum(found, len(twice) - 1)] == keys[at]]


def _covered(n: int, at: np.ndarray, k: int) -> np.ndarray:
    """Which of n places lie in a window of k that begins at one of at."""
    edge = np.zeros(n + 1, np.int32)
    if len(at):
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + k, n), -1)
    return np.cumsum(edge)[:n] > 0


def measure(chunk: T.Chunk, limits: Limits) -> dict[str, np.ndarray]:
    """The figures of each text of a chunk."""
    n_texts, data = len(chunk), chunk.data
    w = T.words(chunk)
    n = len(w.starts)
    n_words = w.last - w.first
    ends_text = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
    chars = ends_text[w.ends] - ends_text[w.starts]
    word_chars = _per_text(chars, w.first, w.last)
    out = {"n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": _per_text(_SYMBOL[data], chunk.starts, chunk.ends)}
    text_of = np.repeat(np.arange(n_texts), n_words)
    salt = T.randoms(1, 31)[0] | np.uint64(1)

    def in_text(hashes: np.ndarray, texts: np.ndarray) -> np.ndarray:
        return T.mix(hashes + (texts.astype(np.uint64) + np.uint64(1)) * salt)

    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    # lines
    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([chunk.starts, breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_stops = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, line_starts)], chunk.ends[np.searchsorted(chunk.ends, line_starts, "right")])
    first_word, last_word = np.searchsorted(w.starts, line_starts), np.searchsorted(w.starts, line_stops)
    real = last_word > first_word
    line_starts, line_stops, first_word, last_word = line_starts[real], line_stops[real], first_word[real], last_word[real]
    line_text = text_of[first_word] if len(first_word) else np.empty(0, np.int64)
    n_lines = np.bincount(line_text, minlength=n_texts)
    dup_lines, dup_chars = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
    if len(line_starts):
        keys = in_text(T.span_hashes(data, line_starts, line_stops, spaces=True), line_text)
        at = _again(keys)
        _, one, of = np.unique(keys[at], return_index=True, return_inverse=True)
        first, sizes = at[one][of], line_stops - line_starts
        if (sizes[at] != sizes[first]).any() or T.differing(data, line_starts[at], line_starts[first], sizes[at]).any():
            # a collision: the bytes themselves decide
            seen: dict = {}
            keys = np.array([seen.setdefault((t, data[a:b].tobytes()), len(seen)) for t, a, b in zip(line_text.tolist(), line_starts.tolist(), line_stops.tolist(), strict=True)], np.uint64)
            at = _again(keys)
        later = np.ones(len(at), bool)
        later[np.unique(keys[at], return_index=True)[1]] = False
        later = at[later]
        dup_lines = np.bincount(line_text[later], minlength=n_texts)
        line_chars = total[last_word] - total[first_word]
        dup_chars = np.bincount(line_text[later], weights=line_chars[later], minlength=n_texts).astype(np.int64)
    out["n_dup_lines"] = dup_lines.astype(np.int64)
    per = np.maximum(word_chars, 1)
    out["dup_line_share"], out["dup_line_char_share"] = dup_lines / np.maximum(n_lines, 1), dup_chars / per

    # n-grams: a repeated window of k words begins with, and ends in, a repeated one of k - 1; its hash rolls on from that one's
    repeat_words = np.zeros(n_texts, np.int64)
    top = dict(limits.top)
    lengths = {3, *top, *dict(limits.repeated)}
    rolled, before = w.hashes.copy(), None
    for k in range(2, max(lengths) + 1):
        inside = np.arange(max(0, n - k + 1)) if before is None else before[:-1][np.diff(before) == 1]
        inside = inside[text_of[inside] == text_of[inside + k - 1]]
        rolled[inside] = rolled[inside] * _ROLL + w.hashes[inside + k - 1]
        keys = in_text(T.mix(rolled[inside] + np.uint64(k)), text_of[inside])
        again = _again(keys)
        at = before = inside[again]
        if k == 3:
            repeat_words = _per_text(_covered(n, at, k), w.first, w.last)
        if k in lengths:
            share = np.zeros(n_texts)
            if len(at) and k in top:
                _, of, sizes = np.unique(keys[again], return_inverse=True, return_counts=True)
                np.maximum.at(share, text_of[at], sizes[of] * (total[at + k] - total[at]))
                share = np.minimum(share / per, 1.0)
            elif len(at):
                share = _per_text(chars * _covered(n, at, k), w.first, w.last) / per
            out[f"{'top' if k in top else 'dup'}_{k}gram_share"] = share
    out["n_repeat_words"] = repeat_words.astype(np.int64)
    return out


def share_names(limits: Limits) -> list[str]:
    return ["dup_line_share", "dup_line_char_share", *[f"top_{k}gram_share" for k, _ in limits.top], *[f"dup_{k}gram_share" for k, _ in limits.repeated]]


def repetition(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs, in its partition, without a shuffle.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier line), n_repeat_words (words
    in 3-word windows found again in the text), base_failed (fewer than least_words words, or over most_repeat_percent of words
    repeated), kept (not base_failed, and no share above its limit), and the shares. Null and empty texts have no words and
    fail; a null id stays null; repeated rows stay. Other columns are left out.
    """
    shares = share_names(limits)
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _INTS) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c} double" for c in shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = {"dup_line_share": limits.lines, "dup_line_char_share": limits.line_chars} | {f"top_{k}gram_share": v for k, v in limits.top} | {f"dup_{k}gram_share": v for k, v in limits.repeated}
        for batch in batches:
            for chunk in T.chunks(batch.column(1)):
                m = measure(chunk, limits)
                failed = (m["n_words"] < limits.least_words) | (100 * m["n_repeat_words"] > limits.most_repeat_percent * m["n_words"])
                kept = ~failed
                for c in shares:
                    kept &= m[c] <= most[c]
                ids = batch.column(0).slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(m[c]) for c in _INTS], pa.array(failed), pa.array(kept), *[pa.array(m[c]) for c in shares]], ["doc_id", *_INTS, "base_failed", "kept", *shares])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("_t")).mapInArrow(run, schema)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs whose text passes, with their columns as they are; decided where the row is, without a join."""
    plain = numbered(docs)
    at = docs.columns.index("text")
    shares = share_names(limits)
    most = {"dup_line_share": limits.lines, "dup_line_char_share": limits.line_chars} | {f"top_{k}gram_share": v for k, v in limits.top} | {f"dup_{k}gram_share": v for k, v in limits.repeated}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(len(batch), bool)
            for chunk in T.chunks(batch.column(at)):
                m = measure(chunk, limits)
                ok = ~((m["n_words"] < limits.least_words) | (100 * m["n_repeat_words"] > limits.most_repeat_percent * m["n_words"]))
                for c in shares:
                    ok &= m[c] <= most[c]
                kept[chunk.first : chunk.first + len(chunk)] = ok
            yield batch.filter(pa.array(kept))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
