"""Each operator against brute force, on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexispark.llm import bpe, line_dedup, lm_bloom, mixing, mpeg_audio, near_dedup, pii, queries, repetition, sharding, textbytes, url_filter
from lexispark.llm.common import few_files
from lexispark.llm.components import components

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, source string, n_chars long, _id long, size long, shard int, _t string, _key string, taken long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    r = random.Random(7)
    vocabulary = ["".join(r.choice("abcdeéäXYZ") for _ in range(r.randint(1, 7))) for _ in range(300)]
    texts: list[str | None] = []
    for _ in range(60):
        lines = [" ".join(r.choices(vocabulary, k=r.randint(3, 15))) for _ in range(r.randint(1, 9))]
        texts.append("\n".join(lines))
    for _ in range(40):
        words = texts[r.randrange(60)].split(" ")
        for _ in range(r.randint(0, 3)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [None, "", " \n\t", "one", "one", "a b c", "A B C", "mail me@x.example.com +1 (988) 555-2485 or 10.1.2.3, 4337166598464399", "it's 12's ''ll  é漢😀  x\n\n", "w " * 30_000 + "end"]
    rows = [(i, t, f"src{i % 4}" if i % 9 else None, len(t or ""), 5, 6, 7, "x", "y", 8) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[3], (None, texts[1], "src0", 1, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, empty, k):
    sets = [(r[0], shingles(r[1], k)) for r in ROWS]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (x, a) in enumerate(sets):
        for j, (y, b) in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: None)
    for i, (x, _) in enumerate(sets):
        if x is not None and (least[root(i)] is None or x < least[root(i)]):
            least[root(i)] = x
    expected = Counter((x, len(s), least[root(i)] if s else x, x == (least[root(i)] if s else x)) for i, (x, s) in enumerate(sets))
    assert Counter(map(tuple, near_dedup.near_duplicates(docs, k).collect())) == expected
    assert near_dedup.near_duplicates(empty, k).isEmpty()


def test_near_duplicates_with_a_large_group_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(80)] = f"n{i}x{r.randrange(999)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t, 4) for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    got = {x["doc_id"]: x["component_id"] for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == label


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 9), (5, 5), (None, 1)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8} | {i: 100 for i in range(100, 161)}


def test_sharding(docs, empty, spark):
    tree = sharding.even_tree(4, 2, 5)
    got = sharding.assign(docs, tree, block_rows=1).collect()
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    assert len(got) == len(ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and 0 <= r["shard"] < 40
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, tree).isEmpty()
    ids = spark.range(8000).withColumnRenamed("id", "k")
    uneven = sharding.HashTree(((sharding.Rack((1.0, 3.0)), sharding.Rack((2.0,))), (sharding.Rack((2.0,)),)))
    counts = {r["shard"]: r["count"] / 1000 for r in sharding.place(ids, uneven, "k").groupBy("shard").count().collect()}
    assert counts == {0: pytest.approx(1, abs=0.2), 1: pytest.approx(3, abs=0.3), 2: pytest.approx(2, abs=0.3), 3: pytest.approx(2, abs=0.3)}
    heavier = sharding.HashTree(((sharding.Rack((1.0, 3.0)), sharding.Rack((2.0,))), (sharding.Rack((4.0,)),)))
    both = sharding.place(sharding.place(ids, uneven, "k", "a"), heavier, "k", "b")
    assert both.where("a <> b and b <> 3").isEmpty() and not both.where("a <> b").isEmpty()


@pytest.mark.parametrize("bound", [lm_bloom.MAX_BROADCAST_BYTES, 0])
def test_language_model(docs, empty, bound):
    tokens = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in ROWS]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = Counter(t for i, ts in tokens if not held(i) for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((i, held(i), len(ts), sum(counts[t] > 0 for t in ts), n, round(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6)) for i, ts in tokens)
    got = lm_bloom.scores(docs, max_broadcast_bytes=bound).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == expected
    assert all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])
    assert lm_bloom.scores(empty, max_broadcast_bytes=bound).isEmpty()


def test_language_model_scores_the_same_above_the_bound(docs):
    """Both routes probe the same bits: pairs that the filter takes for seen, or for more frequent, are so in both."""
    scored = [Counter((r["doc_id"], r["n_tokens"], round(r["score"], 6)) for r in lm_bloom.scores(docs, max_broadcast_bytes=b).collect()) for b in (lm_bloom.MAX_BROADCAST_BYTES, 0)]
    assert scored[0] == scored[1]


def test_language_model_scores_the_same_in_many_segments(docs, monkeypatch):
    monkeypatch.setattr(lm_bloom, "SEGMENT_BYTES", 1 << 10)
    test_language_model_scores_the_same_above_the_bound(docs)


@pytest.mark.parametrize("bound", [lm_bloom.MAX_BROADCAST_BYTES, 0])
def test_language_model_scores_by_brute_force(docs, bound, monkeypatch):
    """With so many probes that no absent pair is found, the score is that of the quantised counts."""
    monkeypatch.setattr(lm_bloom, "SEGMENT_BYTES", 1 << 12)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    texts = [(r[0], [*WORD.findall((r[1] or "").translate(LOWER)), None]) for r in ROWS]
    train = [ts for i, ts in texts if not held(i)]
    words = Counter(t for ts in train for t in ts)
    pairs = Counter(p for ts in train for p in zip(["START", *ts], ts))
    n, v = sum(words.values()), len(words)

    def quantised(c):
        if not c:
            return 0.0
        q = 1
        while 1.5**q <= c + 1e-9:
            q += 1
        # the least and the greatest whole number of the level
        return (math.ceil(1.5 ** (q - 1) - 1e-9) + max(math.ceil(1.5 ** (q - 1) - 1e-9), math.ceil(1.5**q - 1e-9) - 1)) / 2

    def score(ts):
        total = 0.0
        for before, t in zip(["START", *ts], ts):
            p, c = (words[t] + 0.1) / (n + 0.1 * (v + 1)), len(train) if before == "START" else words[before]
            total += math.log10((min(quantised(pairs[before, t]), c) + 20 * p) / (c + 20))
        return total

    got = Counter((r["doc_id"], round(r["score"], 5)) for r in lm_bloom.scores(docs, max_broadcast_bytes=bound, probes=40).collect())
    assert got == Counter((i, round(score(ts), 5)) for i, ts in texts)


def test_bloom_filter_levels():
    pairs = textbytes.randoms(5000, 1)
    counts = np.arange(1, 5001)
    held = lm_bloom.Filter(bits := lm_bloom._segment_bits(pairs, counts), [len(bits)])
    assert (held.levels(pairs) >= lm_bloom.level(counts)).all()
    assert (held.levels(pairs) == lm_bloom.level(counts)).mean() > 0.9
    assert (held.levels(textbytes.randoms(5000, 2)) > 0).mean() < 0.06
    assert (np.abs(lm_bloom.level_count(lm_bloom.level(counts)) / counts - 1) < 0.5).all()


def brute_shares(text):
    w = WORD.findall(text)
    chars = max(1, sum(map(len, w)))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    own = lambda x: sum(map(len, WORD.findall(x)))
    later = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {"dup_line_share": len(later) / max(1, len(lines)), "dup_line_char_share": sum(map(own, later)) / chars}
    for k in range(2, 11):
        grams = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        c = Counter(grams)
        if k < 5:
            out[f"top_{k}gram_share"] = min(1.0, max((n * sum(map(len, g)) for g, n in c.items() if n > 1), default=0) / chars)
        else:
            out[f"dup_{k}gram_share"] = sum(len(w[j]) for j in {i + d for i, g in enumerate(grams) if c[g] > 1 for d in range(k)}) / chars
    return out


def test_repetition(docs, empty):
    limits = repetition.Limits()
    most = {"dup_line_share": limits.lines, "dup_line_char_share": limits.line_chars} | {f"top_{k}gram_share": v for k, v in limits.top} | {f"dup_{k}gram_share": v for k, v in limits.repeated}
    expected, shares = Counter(), defaultdict(list)
    for r in ROWS:
        text = r[1] or ""
        w = WORD.findall(text)
        c = Counter(zip(w, w[1:], w[2:]))
        again = {j + d for j in range(len(w) - 2) if c[w[j], w[j + 1], w[j + 2]] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        own = brute_shares(text)
        kept = not failed and all(own[k] <= v for k, v in most.items())
        expected[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), failed, kept] += 1
        shares[r[0]].append(own)
    got = repetition.repetition(docs).collect()
    assert Counter(tuple(r)[:8] for r in got) == expected
    for r in got:
        assert any(all(r[k] == pytest.approx(v) for k, v in own.items()) for own in shares[r["doc_id"]])
    assert repetition.keep_good(docs).count() == sum(r["kept"] for r in got) and repetition.keep_good(docs).columns == docs.columns
    assert repetition.repetition(empty).isEmpty()


def test_repetition_rejects_beyond_the_base(spark):
    """A page with a paragraph twice: no more than half of its words lie in repeated windows, but 43 % of its characters in repeated n-grams."""
    r = random.Random(1)
    words = [f"w{r.randrange(10**6)}" for _ in range(300)]
    page = " ".join([*words[:65], *words[65:235], *words[:65]])
    got = repetition.repetition(spark.createDataFrame([(1, page), (2, " ".join(words))], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(x["base_failed"], x["kept"]) for x in got] == [(False, False), (False, True)]


def brute_line_dedup(rows):
    """By id and place; every run of 3 lines with words, every two of 50 words together, and every line of 50 words, after its first occurrence."""
    seen, out = set(), {}
    for i, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}):
        lines = text.split("\n")
        own = [(k, x) for k, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for n in range(len(own)):
            for size in (3, 2, 1):
                part = own[n : n + size]
                if len(part) < size or size < 3 and sum(len(WORD.findall(x)) for _, x in part) < 50:
                    continue
                key = tuple(x for _, x in part)
                if key in seen:
                    gone.update(k for k, _ in part)
                seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_line_dedup(docs, empty):
    rows = [r for r in ROWS if r[0] is not None]
    expected = brute_line_dedup(rows)
    got = line_dedup.dedup_lines(docs.where("doc_id is not null"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {r[0]: expected.get(r[0]) for r in rows}
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == len(rows)
    assert line_dedup.dedup_lines(docs).count() == len(ROWS)
    assert line_dedup.dedup_lines(empty).isEmpty()


def test_line_dedup_without_pairs_of_lines(spark):
    line = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    docs = spark.createDataFrame([(1, f"{line('a')}\n{line('b')}\nx"), (2, f"y\n{line('a')}\n{line('b')}")], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs, two_lines=False).where("n_removed > 0").isEmpty() and line_dedup.dedup_lines(docs).where("n_removed = 2").count() == 1


def test_line_dedup_of_two_lines(spark):
    """Two whole lines of 30 words each, among other neighbours, go where they come again; of 30 and 19 they stay, and so does one of 30 alone."""
    line = lambda c, n=30: " ".join(f"{c}{k}" for k in range(n))
    a, b, short = line("a"), line("b"), line("s", 19)
    texts = [f"x1\n{a}\n\n{b}\ny1\n{short}", f"x2\n{a}\n{b}\ny2", f"x3\n{a}\ny3", f"{b}\n{a}", f"{a}\n{short}\nx4", f"z\n{a}\n{short}", f"q\n{a}\n{b}\n{a}\n{b}"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    # lines without a word don't count, so the first text's pair is seen in the second
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {**dict(enumerate(texts)), 1: "x2\ny2", 6: "q"}


def test_line_dedup_writes_few_files(spark):
    """However many shuffle partitions there are, its three checkpoints take a file a core each."""
    texts = [f"own {i}\nsame a\nsame b\nsame c\nlast {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    line_dedup.dedup_lines(docs.limit(1))  # the checkpoint folder is set
    there = lambda: {str(p) for p in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*")}
    before, changed = there(), {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in changed}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs, narrow=True).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == {i: t if i == 0 else f"own {i}\nlast {i}" for i, t in enumerate(texts)}
    assert 0 < len(there() - before) <= 3 * spark.sparkContext.defaultParallelism


def test_few_files_follow_the_size(spark, tmp_path):
    spark.range(1000).write.parquet(f"{tmp_path}/x")
    docs, size = spark.read.parquet(f"{tmp_path}/x"), sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    assert few_files(docs, size) == 1 and few_files(docs, -(-size // 2)) == 2
    assert few_files(docs, 1) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert few_files(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "id long")) == 0  # of unknown size


def test_pii(docs, empty):
    r = {x["doc_id"]: x for x in pii.find(docs).collect()}
    text = next(x[1] for x in ROWS if x[1] and "me@x" in x[1])
    i = next(x[0] for x in ROWS if x[1] == text)
    assert [r[i][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1]
    at = lambda s: f"{text.index(s)}:{text.index(s) + len(s)}"
    base = f"email:{at('me@x.example.com')},ip:{at('10.1.2.3')},card:{at('4337166598464399')},phone:{at('+1 (988) 555-2485')}"
    assert r[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(r[i]["spans"].split(","))
    assert r[0]["spans"] == "" and r[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.find(empty).isEmpty()


def naive_spans(x):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii._luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_patterns_match_their_plain_forms():
    r = random.Random(5)
    for _ in range(5000):
        x = "".join(r.choice("ab@@..-_%+019 ()é1234567") for _ in range(r.randint(0, 60)))
        assert [(s.kind, s.start, s.end) for s in pii.base_spans(x)] == naive_spans(x)
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def brute_em(items, rounds=50):
    """The same model, item by item: prior, accuracies, and each item's posterior under them."""
    prior, accuracy = 0.5, [0.8] * len(items[0])

    def post(v):
        yes, no = prior, 1 - prior
        for x, a in zip(v, accuracy):
            yes *= a if x > 0 else 1 - a if x < 0 else 1
            no *= 1 - a if x > 0 else a if x < 0 else 1
        return yes / (yes + no)

    for _ in range(rounds):
        p = [post(v) for v in items]
        accuracy = [min(0.95, max(0.05, (sum(q if v[j] > 0 else 1 - q if v[j] < 0 else 0 for v, q in zip(items, p)) + 8) / (sum(v[j] != 0 for v in items) + 10))) for j in range(len(accuracy))]
        prior = min(0.99, max(0.01, (sum(p) + 1) / (len(p) + 2)))
    return prior, accuracy, [post(v) for v in items]


def test_pii_estimates_reliabilities():
    r = np.random.default_rng(1)
    truth, accuracy = r.random(20_000) < 0.7, (0.95, 0.8, 0.65)
    votes = [tuple(int(1 if (t == (r.random() < a)) else -1) for a in accuracy) for t in truth]
    prior, found = pii.estimate(dict(Counter(votes)))
    assert prior == pytest.approx(0.7, abs=0.08) and list(found) == pytest.approx(accuracy, abs=0.08)
    w = pii.train({(*v, 0, 0, 0): n for v, n in Counter(votes).items()}, prior, found)
    right = np.mean([((np.dot(w, pii.inputs((*v, 0, 0, 0))) > 0) == t) for v, t in zip(votes, truth)])
    assert right > 0.93
    some = [tuple(x * (r.random() < 0.7) for x in v) for v in votes[:300]]
    prior, found = pii.estimate(dict(Counter(some)))
    want = brute_em(some)
    assert prior == pytest.approx(want[0]) and list(found) == pytest.approx(want[1])
    assert list(pii.posteriors(np.array(some, float), prior, found)) == pytest.approx(want[2])


def test_pii_labelers_disagree():
    def all_votes(text):
        base = pii.base_spans(text)
        return [(pii.KINDS[s.kind], dict(zip(pii.LABELERS, pii.votes(text, s, sorted(base, key=lambda o: o.start))))) for s in pii.candidates(text, base)]

    ((kind, v),) = all_votes("call us: +44 (212) 666-7788 now")
    assert kind == "phone" and v == {"pattern": 1, "layout": 1, "registry": 1, "touch": 1, "cue": 1, "company": 0}
    ((kind, v),) = all_votes("version 010.1.2.3")
    assert kind == "ip" and v == {"pattern": 1, "layout": -1, "registry": -1, "touch": 1, "cue": -1, "company": 0}
    (a, b) = all_votes("x@y.example and 8.8.8.8")
    assert a[1]["registry"] == -1 and b[1]["registry"] == 1 and a[1]["company"] == b[1]["company"] == 1
    ((kind, v),) = all_votes("card 3782-822463-10005")
    assert kind == "card" and v == {"pattern": -1, "layout": 1, "registry": 1, "touch": 1, "cue": 1, "company": 0}
    assert all_votes("card 3782-822463-10006") == [] and all_votes("#+1 (117) 555 12345678x")[0][1]["touch"] == -1
    ((kind, v),) = all_votes("write ann (at) mail (dot) org please")
    assert kind == "email" and (v["pattern"], v["layout"], v["registry"], v["cue"]) == (-1, 1, 1, 1)


def test_pii_takes_loose_spans_in_linear_time(spark):
    text = "555-123-4567 " * 20_000
    began = time.monotonic()
    assert len(pii.candidates(text, pii.base_spans(text))) == 20_000 and time.monotonic() - began < 1
    mixed = "".join(f"a{i}@b.com 555-123-4567 " for i in range(5000))
    base = pii.base_spans(mixed)
    got = pii.candidates(mixed, base)
    assert len(got) == 10_000 and not any(a.start < b.end and b.start < a.end for a, b in zip(sorted(got, key=lambda s: s.start), sorted(got, key=lambda s: s.start)[1:]))


def test_pii_adds_what_it_believes(spark):
    """Phones without a plus among many with one, and an address written out, are added; what fails its check never is."""
    r = random.Random(4)
    rows = [(i, f"text {i} phone +1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)} mail bob{i}@host{i}.org end") for i in range(200)]
    rows += [(900, "phone (212) 555-1234 end"), (901, "mail eve (at) host (dot) org end"), (902, "card 3782-822463-10006"), (903, None), (None, "")]
    got = {x["doc_id"]: x for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900]["spans"] == "phone:6:20" and got[900]["n_phone"] == 0 and got[901]["spans"] == "email:5:28"
    assert all((x["n_spans"], x["n_added"]) == (0, 0) for i, x in got.items() if i in (902, 903, None))
    assert all(got[i]["n_added"] == 0 and got[i]["n_spans"] == 2 for i in range(200))


URLS = ["https://WWW.Example.net/en/a?x=1#y", "http://a.example.net/fr/", "http://shop.org/fr/x", "https://example.com/de/b", "https://example.com/x/index.html?utm_source=1&b=2&a=1", "http://m.example.com/x?a=1&b=2", "no scheme", "", None, "http://[::1", "ftp://h"]


def test_sharded_files(spark, tmp_path):
    """Every row in its shard's folder, a large shard in several files, rows with repeated and null ids once each, columns as they are."""
    rows = [(i % 90, f"t{i}", 5) for i in range(300)] + [(None, "x", 1), (None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _shard int")
    tree = sharding.HashTree(((sharding.Rack((1.0, 50.0)),),))
    sharding.write_shards(docs, tree, str(tmp_path / "s"), rows_a_file=40)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"], r["_shard"]) for r in back.collect()) == Counter(rows)
    want = {(r["doc_id"], r["text"]): r["shard"] for r in sharding.place(docs, tree, "doc_id").collect()}
    assert all(want[r["doc_id"], r["text"]] == r["shard"] for r in back.collect())
    assert len(list((tmp_path / "s" / "shard=1").glob("*.parquet"))) >= 4


def test_url_filter_with_a_frequent_url(spark):
    pages = spark.createDataFrame([(i, "http://a.com/x" if i % 3 else None) for i in range(400)] + [(900, "http://a.com/y")], "page_id long, url string")
    got = url_filter.filter_urls(pages, spark.createDataFrame([("a.com/x",)], "u string"))
    assert got.count() == 401 and got.where("listed").count() == 266 and got.where("page_id = 900 and verdict = 'allow'").count() == 1


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, 1, "z") for i, u in enumerate([*URLS, URLS[4]])] + [(None, None, 1, "z")], "page_id long, url string, block long, host string")
    listed = spark.createDataFrame([("example.com/x?a=1&b=2",), (None,), ("",), ("example.com/x?a=1&b=2",)], "u string")
    got = {(r["page_id"]): tuple(r)[1:] for r in url_filter.filter_urls(pages, listed).collect()}
    assert len(got) == len(URLS) + 2
    assert got[0] == ("www.example.net", "/en/a", "example.net/en/", "allow", False)
    assert got[1][2:4] == ("net/", "block") and got[2][2:4] == ("org/fr/", "allow") and got[3][2:4] == ("example.com/de/", "block")
    assert got[4][2:] == (None, "block", True) and got[5][2:] == (None, "block", True) and got[11][2:] == (None, "block", True)
    assert got[8] == got[6] == ("", "", None, "allow", False) == got[None]
    assert url_filter.filter_urls(pages.limit(0), listed).isEmpty()
    assert url_filter.filter_urls(pages, listed.limit(0)).where("listed").isEmpty()


def test_bloom_passes_all_that_is_listed(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h/"), F.col("id").cast("string")).alias("u"))
    pages = spark.range(9000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    got = url_filter.filter_urls(pages, listed)
    assert got.where("listed").count() == 3000 and got.where("listed and page_id >= 3000").isEmpty()


def test_mpeg_audio(docs, empty):
    got = mpeg_audio.digests(docs).collect()
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
            assert r["media_sha256"] == hashlib.sha256(mpeg_audio.write(payload)).hexdigest() and "bad_crc=0;skipped=0" in r["feature"]
            assert r["duration_us"] == len(r["seek_offsets"]) * 1152 * 1_000_000 // 44100 and r["seek_offsets"] == sorted(set(r["seek_offsets"]))
    assert len(got) == len(ROWS) and mpeg_audio.digests(empty).isEmpty()
    back = mpeg_audio.parse(mpeg_audio.store(docs)).where("doc_id = 5").first()
    assert bytes(back["payload"]) == mpeg_audio.padded(texts[5].encode()) and len(back["offsets"]) == back["n_frames"]


def test_mpeg_resynchronises_and_finds_damage():
    payload = random.Random(2).randbytes(9000)
    media = mpeg_audio.write(payload)
    whole = mpeg_audio.read(media)
    assert whole.payload == payload and whole.table["frames"] == len(whole.offsets) and whole.duration_us == len(whole.offsets) * 1152 * 1_000_000 // 44100
    junk = mpeg_audio.read(b"\xff\xfa\x00junk" + media + b"\xff\xffzz" + b"TAG".ljust(128))
    assert junk.payload == payload and junk.skipped > 0 and "ID3v1" in junk.tags
    assert [a - b for a, b in zip(junk.offsets, whole.offsets)] == [7] * len(whole.offsets)
    at = whole.offsets[3] + 10
    bad = mpeg_audio.read(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    assert bad.bad_crc == 1 and bad.payload == payload
    assert mpeg_audio.read(b"").offsets == [] and mpeg_audio.read(bytes(500)).skipped == 500


def crc_of_bits(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ int(b)
        c = c << 1 & 0xFFFF
        if top:
            c ^= 0x8005
    return c


def with_crc(head, body_bits, length):
    """A frame made by hand: header, the CRC of the header's last two bytes and of the given bits, the bits, zeros."""
    bits = "".join(f"{x:08b}" for x in head[2:]) + body_bits
    body = int(body_bits.ljust(-(-len(body_bits) // 8) * 8, "0"), 2).to_bytes(-(-len(body_bits) // 8), "big")
    return (head + crc_of_bits(bits).to_bytes(2, "big") + body).ljust(length, b"\0")


def test_mpeg_reads_every_version_and_layer():
    read = mpeg_audio.read
    # MPEG-2 Layer III, 64 kbit/s, 24 kHz, mono, without a CRC: 192 bytes, 576 samples, 24 ms
    low = (b"\xff\xf3\x84\xc0" + bytes(9)).ljust(192, b"\x55")
    a = read(low * 5)
    assert (a.offsets, a.samples, a.rate, a.duration_us, a.unchecked, a.skipped) == ([0, 192, 384, 576, 768], 2880, 24000, 120_000, 5, 0) and a.payload == b"\x55" * 179 * 5
    # MPEG-2.5 Layer III, 8 kbit/s, 8 kHz: 72 bytes, 72 ms
    a = read(b"zz" + b"\xff\xe3\x18\xc0".ljust(72, b"\1") * 3)
    assert (a.offsets, a.duration_us, a.skipped, a.rate) == ([2, 74, 146], 216_000, 2, 8000)
    # MPEG-1 Layer II, 192 kbit/s, 44.1 kHz, stereo: 94 bits of allocation a channel, and two for each subband in use
    allocation = "0001" + "0" * (188 - 4) + "10"
    two = with_crc(b"\xff\xfc\xa0\x00", allocation, 626)
    a = read(two * 3)
    assert (len(a.offsets), a.samples, a.bad_crc, a.unchecked, a.kbits_most) == (3, 3456, 0, 0, 192)
    assert read(two + two[:7] + b"\x80" + two[8:] + two).bad_crc == 1
    # the same in joint stereo: from subband 4 on one allocation is for both channels, 17 subbands in use
    joint = "1111" + "0" * 12 + "0" * 16 + "1000" * 7 + "0" * 36 + "0" * 14 + "01" * 15
    assert read(with_crc(b"\xff\xfc\xa0\x40", joint, 626) * 2).bad_crc == 0
    # MPEG-1 Layer I, 64 kbit/s, 44.1 kHz, mono and stereo: 68 bytes, 384 samples
    one = with_crc(b"\xff\xfe\x20\xc0", "0101" * 32, 68)
    a = read(one * 2 + with_crc(b"\xff\xfe\x20\x00", "0110" * 64, 68))
    assert (len(a.offsets), a.samples, a.bad_crc) == (3, 1152, 0)
    # headers of another kind don't confirm one another
    assert read(b"\xff\xf3\x84\xc0" + bytes(188) + b"\xff\xfb\x90\x00" + bytes(100)).offsets == []
    # free format, reserved versions, layers and rates
    for head in (b"\xff\xfb\x00\x00", b"\xff\xeb\x90\x00", b"\xff\xf9\x90\x00", b"\xff\xfb\x9c\x00", b"\xff\xfb\xf0\x00"):
        assert read(head + bytes(413)).offsets == []


def test_mpeg_reads_tables_and_tags():
    sound = (b"\xff\xfb\x90\x00" + bytes(32)).ljust(417, b"\7")
    vbri = b"\xff\xfb\x90\x00" + bytes(32) + b"VBRI" + bytes([0, 1, 0, 0, 0, 75]) + (417 * 5).to_bytes(4, "big") + (4).to_bytes(4, "big") + bytes([0, 4, 0, 2, 0, 2, 0, 1]) + bytes([0, 208, 0, 209, 0, 208, 0, 209])
    a = mpeg_audio.read(vbri.ljust(417, b"\0") + sound * 4)
    assert a.table == {"frames": 4, "bytes": 2085, "every": 1, "points": [416, 418, 416, 418]} and a.offsets == [417, 834, 1251, 1668]
    info = (b"\xff\xfb\x90\x00" + bytes(32) + b"Info" + bytes([0, 0, 0, 1, 0, 0, 0, 4])).ljust(417, b"\0")
    assert mpeg_audio.read(info + sound * 4).table == {"frames": 4}
    title = b"\0" + b"t" * 299
    plain = b"TIT2" + (300).to_bytes(4, "big") + b"\0\0" + title + b"TPE1" + (3).to_bytes(4, "big") + b"\0\0" + b"\0me"
    tag = lambda version, flags, body: b"ID3" + bytes([version, 0, flags]) + bytes([len(body) >> 21 & 127, len(body) >> 14 & 127, len(body) >> 7 & 127, len(body) & 127]) + body
    a = mpeg_audio.read(tag(3, 0, plain) + sound * 2)
    assert a.tags == {"TIT2": title, "TPE1": b"\0me"} and len(a.offsets) == 2 and a.skipped == 0
    assert mpeg_audio.read(tag(3, 0x40, (6).to_bytes(4, "big") + bytes(6) + plain) + sound).tags["TPE1"] == b"\0me"
    safe = b"TIT2" + bytes([0, 0, 2, 44]) + b"\0\0" + title
    assert mpeg_audio.read(tag(4, 0x10, safe) + b"3DI" + bytes(7) + sound).offsets == [10 + len(safe) + 10]
    assert mpeg_audio.read(tag(2, 0, b"TT2" + (4).to_bytes(3, "big") + b"\0abc") + sound).tags == {"TT2": b"\0abc"}
    assert mpeg_audio.read(tag(3, 0x80, b"PCNT" + (5).to_bytes(4, "big") + b"\0\0" + b"a\xff\x00\xe0bc") + sound).tags == {"PCNT": b"a\xff\xe0bc"}
    assert mpeg_audio.read(b"ID3" + b"\xff" * 20).tags == {}


def reference_encoding():
    v = bpe.Vocabulary(open(VOCABULARY, "rb").read())
    return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_on_documents(docs, empty):
    _, enc = reference_encoding()
    texts = {r[0]: r[1] for r in ROWS if r[0] is not None}
    for r in bpe.round_trip(docs, VOCABULARY).collect():
        if r["doc_id"] is not None:
            text = texts[r["doc_id"]] or ""
            ids = enc.encode_ordinary(text)
            assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    tokens = bpe.decode(bpe.encode(docs.select("doc_id", "text"), VOCABULARY), VOCABULARY)
    for r in tokens.where("doc_id in (1, 101, 107, 108)").collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert all(a < b for a, b in zip(r["bpe_offsets"], r["bpe_offsets"][1:]))
    assert bpe.round_trip(empty, VOCABULARY).isEmpty()


def test_bpe_matches_on_odd_texts():
    v, enc = reference_encoding()
    r = random.Random(3)
    texts = ["".join(r.choice("ab'sstdmrevl  \n\t .,!1é9٣漢  😀'’") for _ in range(r.randint(0, 30))) for _ in range(5000)] + [None, "'" * 200, "a" * 5000, "abcdefgh" * 300, " " * 70]
    for c in textbytes.chunks(pa.array(texts, pa.string())):
        ids, ends = v.encode(c)
        for i in range(len(c)):
            own = ids[ends[i] : ends[i + 1]]
            text = texts[c.first + i] or ""
            assert own.tolist() == enc.encode_ordinary(text) and v.decode(own).tobytes() == text.encode()


def test_mixing(docs, empty):
    got = mixing.mix(docs)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    size = lambda t: len(WORD.findall(t or ""))
    totals = Counter()
    for r in ROWS:
        totals[r[2]] += size(r[1])
    order = sorted((s for s in totals if s is not None), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, target = set(order), {}
    while True:
        rest, w = sum(totals.values()) - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / w > 3 * totals[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        for s in over:
            target[s] = 3 * totals[s]
            free.discard(s)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in rows) == Counter((r[0], size(r[1]), totals[r[2]], round(target[r[2]], 6)) for r in ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    by = defaultdict(int)
    for r in rows:
        by[round(r["target"], 6)] += r["taken"]
    expected = Counter()
    for s in order:
        expected[round(target[s], 6)] += target[s]
    assert all(abs(by[k] - v) <= 2 for k, v in expected.items())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).isEmpty()


@pytest.mark.parametrize("name", ["op2_hash_tree_sharding", "op4_repetition_rules", "op10_source_mix"])
def test_sql_agrees_on_odd_rows(docs, tmp_path, name):
    """The queries and their SQL over nulls, empty and long texts, ties and repeated rows."""
    duckdb = pytest.importorskip("duckdb")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES[name](docs.sparkSession, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
        found = con.execute(queries.ORACLE[name])
        names = [x[0] for x in found.description]
        plain = lambda v: round(v, 9) if isinstance(v, float) else v
        want = Counter(tuple(plain(v) for _, v in sorted(zip(names, r))) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()) == want


def test_every_query_is_registered():
    assert sorted({int(q[2:].split("_")[0]) for q in queries.QUERIES}) == list(range(1, 11))


def thue_morse(n, letters="ab"):
    return "".join(letters[i.bit_count() & 1] for i in range(n))


def test_words_of_a_regular_build_do_not_collide(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    a, b = thue_morse(8192), thue_morse(8192, "ba")
    texts = [a, b, f"{a} x {b} y", f"{a}\n{b}\n" + " ".join(f"w{i}" for i in range(60)), f"{a[:5000]} {b[:5000]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs, 4).collect()} == {i: i for i in range(5)}
    v, enc = reference_encoding()
    for c in textbytes.chunks(pa.array(texts, pa.string())):
        ids, ends = v.encode(c)
        for i in range(len(c)):
            assert ids[ends[i] : ends[i + 1]].tolist() == enc.encode_ordinary(texts[c.first + i])
    assert repetition.repetition(docs).where("doc_id = 3").first()["n_dup_lines"] == 0
    scored = {r["doc_id"]: r for r in lm_bloom.scores(docs).collect()}
    known = {w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in WORD.findall(t)}
    assert [scored[i]["n_known"] for i in range(5)] == [sum(w in known for w in WORD.findall(t)) + 1 for i, t in enumerate(texts)]


def test_pieces_whose_hashes_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(textbytes, "span_hashes", lambda data, a, b, lower=False, spaces=False: (b - a).astype(np.uint64))
    v, enc = reference_encoding()
    texts = ["one two six ten", "", "aa bb aa bb cc"]
    for c in textbytes.chunks(pa.array(texts, pa.string())):
        ids, ends = v.encode(c)
        assert [ids[ends[i] : ends[i + 1]].tolist() for i in range(3)] == [enc.encode_ordinary(t) for t in texts]
        assert repetition.measure(next(textbytes.chunks(pa.array(["ab\ncd\nab\ne"], pa.string()))), repetition.Limits())["n_dup_lines"].tolist() == [1]


def test_a_large_vocabulary_loads():
    import base64
    import itertools

    words = [bytes(x) for n in (1, 2, 3) for x in itertools.islice(itertools.product(range(256), repeat=n), 256 if n == 1 else 65_536 if n == 2 else 240_000)]
    v = bpe.Vocabulary(b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate(words)))
    assert len(v.pairs) > 1 << 18 and v.merge_long(bytes([0, 1, 2])) == (v.ranks[bytes([0, 1, 2])],)
    data = np.frombuffer(bytes([0, 1, 2, 9]), np.uint8)
    assert v.merge_many(data, np.array([0]), np.array([4])) == [v.merge_long(data.tobytes())]
