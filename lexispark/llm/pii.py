"""Personal data by weak supervision.

Candidate spans come from four fixed patterns (email, ip, card, phone) and from looser ones (written-out emails, phones without a plus, cards in other shapes or of
other lengths); a loose one must pass its kind's check too (Luhn, number of digits). Six labelers vote for, against, or not at all on each candidate: two regex labelers
(the fixed pattern; a usual layout), a gazetteer labeler (registries: top-level and reserved domains, reserved address ranges, card issuers and their lengths, area
codes), and three context labelers (what the span touches; cue words and counter-cues around it; personal data of another kind nearby). Expectation-maximisation
over the votes estimates each labeler's reliability, and its posteriors train a logistic span classifier on votes and features of the span. Spans of
the fixed patterns always stay; a loose candidate is added if the classifier believes it.

What EM and the classifier learn from is the table of vote and feature patterns with their counts over all documents: its size is bounded by the number
of patterns (3 to the number of labelers, times the cells of the features, for each kind), not by the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in forms that run in linear time and match the same spans.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Loose forms: name (at) host (dot) tld; national and international phones without a plus; card digits with other separators.
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[\[(]\s?at\s?[\])]\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[\[(]\s?dot\s?[\])]\s?)[A-Za-z0-9-]{1,63}){1,4}", re.I)
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:(?:\+[0-9]{1,3}[\x20-]?)?\([0-9]{3}\)\x20?|00[0-9]{1,3}[\x20-]|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9.-])")
_LOOSE_CARD = re.compile(r"(?<![0-9./_-])[0-9]{4}(?:(?:[./_][0-9]{4}){3}|[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{9})(?![0-9])(?![./_-][0-9])")

_MAIL_LAYOUT = re.compile(r"[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")

#: Gazetteers, as small fixed lists.
TLDS = frozenset("com net org edu gov mil int info biz io de fr es uk eu it nl ch at be us ca au jp cn in br mx ru pl se no dk fi pt ie nz za kr".split())
RESERVED_DOMAINS = ("example", "test", "invalid", "localhost", "example.com", "example.net", "example.org")
CUES = {
    "email": frozenset("email e-mail mail contact contacto kontakt courriel correo write address adresse".split()),
    "ip": frozenset("ip host server address addr from login client visitor".split()),
    "card": frozenset("card visa mastercard amex credit carte karte tarjeta payment".split()),
    "phone": frozenset("phone tel telephone call fax mobile cell appelez telefon telefono móvil handy".split()),
}
COUNTER_CUES = frozenset("version ver v release isbn issn order invoice ref reference serial sku id page chapter section lat lon".split())
_BEFORE, _AFTER, _NEAR = 80, 40, 200
LABELERS = ("pattern", "layout", "registry", "touch", "cue", "company")
#: Cells of a span's features: its length, its separators, whether it has letters.
FEATURES = (4, 3, 2)


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them from left to right; each @ is tried with the run of local characters before it."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind's pattern, without those that fail its check."""
    out = [Span(0, a, b, True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split(".")):
            out.append(Span(1, *m.span(), True))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(Span(2, *m.span(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(Span(3, *m.span(), True))
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Base spans, and loose ones that overlap none of them, nor each other."""
    loose = []
    if "(" in text or "[" in text:
        loose += [Span(0, *m.span(), False) for m in _LOOSE_EMAIL.finditer(text)]
    loose += [Span(3, *m.span(), False) for m in _LOOSE_PHONE.finditer(text)]
    loose += [Span(2, *m.span(), False) for m in _LOOSE_CARD.finditer(text) if _luhn("".join(c for c in m[0] if c.isdigit()))]
    if not loose:
        return list(base)
    # one sweep: ends of base spans, running on, in the order of their starts
    starts, ends = [], []
    for x in sorted(base, key=lambda x: x.start):
        starts.append(x.start)
        ends.append(max(x.end, ends[-1] if ends else 0))
    out, done = list(base), 0
    for x in sorted(loose, key=lambda x: (x.start, x.end)):
        i = bisect.bisect_left(starts, x.end)
        if x.start >= done and (not i or ends[i - 1] <= x.start):
            out.append(x)
            done = x.end
    return out


def _layout(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        return 1 if _MAIL_LAYOUT.fullmatch(re.sub(r"\s?[\[(]\s?dot\s?[\])]\s?", ".", re.sub(r"\s?[\[(]\s?at\s?[\])]\s?", "@", span))) else -1
    if kind == 1:
        return 1 if all(p == str(int(p[-3:])) for p in span.split(".")) else -1
    if kind == 2:
        return 1 if re.fullmatch(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}", span) else -1
    return 1 if re.fullmatch(r"(?:\+[0-9]{1,3}|00[0-9]{1,3})?[ -]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}", span) else -1


def _registry(kind: int, span: str, digits: str) -> int:
    if kind == 0:
        labels = [x for x in re.split(r"[^A-Za-z0-9-]+", span.lower().replace("(dot)", ".").replace("[dot]", ".").rstrip(")]")) if x]
        host = ".".join(labels[-2:])
        return -1 if labels[-1] not in TLDS or host in RESERVED_DOMAINS or labels[-1] in RESERVED_DOMAINS else 1
    if kind == 1:
        a, b = (int(p[-3:]) for p in span.split(".")[:2])
        return -1 if a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32 else 1
    if kind == 2:
        n, two, four = len(digits), int(digits[:2]), int(digits[:4])
        known = digits[0] == "4" and n in (13, 16, 19) or (51 <= two <= 55 or 2221 <= four <= 2720) and n == 16 or two in (34, 37) and n == 15 or (four == 6011 or two == 65 or 3528 <= four <= 3589) and 16 <= n <= 19
        return 1 if known else -1
    own = digits.removeprefix("00")
    national = own[1:] if len(own) == 11 and own[0] == "1" else own
    if len(national) == 10 and (own is not national or not span.startswith(("+", "00"))):
        return 1 if national[0] in "23456789" and national[3] in "23456789" else -1
    return 1 if own[:1] in set("23456789") and 9 <= len(own) <= 13 else -1


def votes(text: str, s: Span, others: list[Span] = ()) -> tuple[int, ...]:
    """Each labeler's vote: 1 for personal data, -1 against, 0 for none. others: the text's base spans, by their starts."""
    span = text[s.start : s.end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    left, right = text[s.start - 1 : s.start] if s.start else "", text[s.end : s.end + 1]
    touch = -1 if left.isalnum() or right.isalnum() or left in ("#", "$", "_", "/", "=") else 1
    # whole words only, so those cut by the window's edge are left out
    before = re.findall(r"[\w-]+", text[max(0, s.start - _BEFORE) : s.start].lower())
    after = re.findall(r"[\w-]+", text[s.end : s.end + _AFTER].lower())
    cue = 1 if CUES[KINDS[s.kind]].intersection(before[-8:] + after[:3]) else -1 if COUNTER_CUES.intersection(before[-2:]) else 0
    i = bisect.bisect_left(others, s.start - _NEAR, key=lambda o: o.start)
    company = 0
    while i < len(others) and others[i].start <= s.end + _NEAR:
        if others[i].kind != s.kind:
            company = 1
            break
        i += 1
    return 1 if s.base else -1, _layout(s.kind, span, digits), _registry(s.kind, span, digits), touch, cue, company


def features(text: str, s: Span) -> tuple[int, ...]:
    """The cell of each of FEATURES."""
    span = text[s.start : s.end]
    return min(3, len(span) // 10), min(2, sum(not c.isalnum() for c in span) // 2), int(any(c.isalpha() for c in span))


def posteriors(patterns: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """The probability that each pattern of votes is personal data, by the one-coin model."""
    return 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + (patterns * np.log(accuracy / (1 - accuracy))).sum(axis=1))))


def estimate(counts: dict[tuple, int], rounds: int = 50) -> tuple[float, np.ndarray]:
    """EM of the one-coin model: the prior of personal data, and each labeler's accuracy, from counts of vote patterns. A little is added to each count, so that none is 0 or 1."""
    patterns = np.array([k for k in counts], float)
    n = np.array(list(counts.values()), float)
    prior, accuracy = 0.5, np.full(patterns.shape[1], 0.8)
    for _ in range(rounds):
        post = posteriors(patterns, prior, accuracy)
        right = (n[:, None] * np.where(patterns > 0, post[:, None], np.where(patterns < 0, 1 - post[:, None], 0))).sum(axis=0)
        cast = (n[:, None] * (patterns != 0)).sum(axis=0)
        accuracy = np.clip((right + 8) / (cast + 10), 0.05, 0.95)
        prior = float(np.clip((n @ post + 1) / (n.sum() + 2), 0.01, 0.99))
    return prior, accuracy


def inputs(pattern: tuple) -> list[float]:
    """What the classifier sees of a pattern: the votes, each feature's cell as a 0/1 vector, a constant."""
    n = len(pattern) - len(FEATURES)
    return [*map(float, pattern[:n]), *[float(cell == i) for cell, cells in zip(pattern[n:], FEATURES, strict=True) for i in range(cells)], 1.0]


def train(counts: dict[tuple, int], prior: float, accuracy: np.ndarray, rounds: int = 25, penalty: float = 1e-2) -> np.ndarray:
    """Weights of the span classifier over inputs(), fitted to EM's posteriors by Newton steps with a small penalty. counts is by votes and features."""
    x, n = np.array([inputs(k) for k in counts]), np.array(list(counts.values()), float)
    target = posteriors(x[:, : len(accuracy)], prior, accuracy)
    w, share = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (share * (p - target)) + penalty * w
        w -= np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), slope)
    return w


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_t"))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, np.ndarray]:
    """The classifier of each kind, from the vote and feature patterns of all documents' candidates. A kind without candidates has none."""
    return {kind: train(counts, *estimate(_by_votes(counts))) for kind, counts in patterns(docs, id_col, text_col).items()}


def _by_votes(counts: dict[tuple, int]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for k, v in counts.items():
        out[k[: len(LABELERS)]] = out.get(k[: len(LABELERS)], 0) + v
    return out


def patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[int, dict[tuple, int]]:
    """For each kind with candidates: how often each pattern of votes and features occurs among all documents' candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, int] = {}
        for batch in batches:
            for x in batch.column(1):
                text = x.as_py()
                base = base_spans(text)
                near = sorted(base, key=lambda o: o.start)
                for s in candidates(text, base):
                    key = (s.kind, *votes(text, s, near), *features(text, s))
                    counts[key] = counts.get(key, 0) + 1
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k, _ in rows], pa.list_(pa.int32())), pa.array([v for _, v in rows], pa.int64())], ["pattern", "n"])

    out: dict[int, dict[tuple, int]] = {}
    for r in sorted(_texts(docs, id_col, text_col).mapInArrow(run, "pattern array<int>, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()):
        out.setdefault(r["pattern"][0], {})[tuple(r["pattern"][1:])] = r["n"]
    return out


def find(docs: DataFrame, models: dict[int, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (of the base patterns), base_sha256, spans, n_spans, n_added.

    spans: kind:start:end in code points, by kind as listed, then start, comma-joined: the base spans and loose candidates that the classifier gives
    at least `least`. Null counts as the empty text (no spans); ids may be null or repeat; other columns are left out. Without models,
    they are fitted on docs first.
    """
    models = fit(docs, id_col, text_col) if models is None else models
    weights = {k: w.tolist() for k, w in models.items()}
    names = ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans", "n_added"]

    def joined(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.kind, s.start)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py()
                base = base_spans(text)
                spans, near = list(base), None
                for s in candidates(text, base)[len(base) :]:
                    near = sorted(base, key=lambda o: o.start) if near is None else near
                    if (w := weights.get(s.kind)) and 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, inputs((*votes(text, s, near), *features(text, s))), strict=True)))) >= least:
                        spans.append(s)
                n = [0] * len(KINDS)
                for s in base:
                    n[s.kind] += 1
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans), len(spans) - len(base)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.int64()]
            cols = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names)

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")
