"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline as P
from lexispark.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for i in range(40):
        lines = [" ".join(r.choices(vocabulary, k=12)) for _ in range(8)]
        out.append((i, "\n".join(lines), "en", f"src{i % 3}", 0))
    shared = "\n".join(" ".join(r.choices(vocabulary, k=10)) for _ in range(4))
    out += [(40, out[0][1] + "\n" + shared, "en", "src0", 0), (41, shared + "\n" + out[5][1].replace("w1", "v1"), "en", None, 0), (42, "too short", "en", "src1", 0), (43, "again and again " * 40, "en", "src1", 0), (44, None, None, None, None), (45, "", "en", "src2", 0)]
    near = out[7][1].split(" ")
    near[3] = "changed"
    out.append((46, " ".join(near), "fr", "src1", 0))
    return out


def test_stages(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long")
    by = dict(P.STAGES)
    assert list(by) == ["quality rules", "line dedup", "near dedup", "source mixing", "byte bpe"]
    kept = by["quality rules"](spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {*range(42), 46}
    lines = by["line dedup"](spark, kept, "")
    got = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert len(got) == 43 and got[0] == rows()[0][1] and len(got[40].split("\n")) == 4
    near = by["near dedup"](spark, kept, "")
    ids = {r["doc_id"] for r in near.collect()}
    assert 46 not in ids and 7 in ids and ids >= {*range(40)}
    mixed = by["source mixing"](spark, near, "")
    want = {r["doc_id"]: r["taken"] for r in mixing.mix(near).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert words == {k: v for k, v in want.items() if v}
    last = by["byte bpe"](spark, mixed, "")
    assert last.where("not round_trip").isEmpty() and last.count() == mixed.count()
    for stage in (kept, lines, near, mixed):
        assert stage.columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.isEmpty()


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _h long, _gone long, _removed int, _rid long, n_lines int, n_removed int, size long, taken long, _mid long, _words int, n_tokens string, bpe_ids int, round_trip string, `a.b` int, _whole int"


def odd_rows():
    """Null ids and sources, repeated ids with equal and with other texts, equal rows, and columns that clash with what the stages add."""
    r = random.Random(5)
    texts = [" ".join(r.choices([f"w{i}" for i in range(2000)], k=80)) for _ in range(8)]
    near = texts[0].split(" ")
    near[40] = "other"
    passage = "\n".join(" ".join(r.choices([f"p{i}" for i in range(500)], k=20)) for _ in range(4))
    ids = [(0, texts[0]), (1, " ".join(near)), (1, texts[1]), (2, texts[2]), (2, texts[2]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[3]), (3, texts[5]), (4, texts[6] + "\n" + passage), (None, texts[7] + "\n" + passage), (5, passage + "\n" + texts[6][::-1])]
    return [(i, t, "en", None if k % 4 == 0 else f"s{k % 3}", len(t), *range(11), "x", k, "y", 3, k) for k, (i, t) in enumerate(ids)]


def test_rows_with_null_and_repeated_ids_and_clashing_names(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    by = dict(P.STAGES)
    plain = lambda df: Counter((r["doc_id"], r["text"]) for r in df.collect())
    all_rows = Counter((r[0], r[1]) for r in rows)
    kept = by["quality rules"](spark, docs, "")
    assert plain(kept) == all_rows and kept.columns == docs.columns
    lines = by["line dedup"](spark, kept, "")
    want = Counter(all_rows)
    # the passage stays where the least id has it, and goes from the later id and the null id, which is last
    for i in (5, None):
        (old,) = [t for d, t in all_rows if d == i and "\n" in t]
        passage = rows[10][1].split("\n", 1)[1]
        want[i, old] -= 1
        want[i, old.replace("\n" + passage, "").replace(passage + "\n", "")] += 1
    assert plain(lines) == +want and lines.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())
    near = by["near dedup"](spark, kept, "")
    # of 0 and its near copy 1 the first stays; the other text of 1 stays; of equal rows one stays
    assert plain(near) == Counter({k: 1 for k in all_rows if k != (1, rows[1][1])}) and near.columns == docs.columns
    mixed = by["source mixing"](spark, kept, "")
    words = Counter()
    for r in mixed.collect():
        words[r["doc_id"], r["source"]] += len(WORD.findall(r["text"]))
    want = Counter()
    for r in mixing._taken(kept, "doc_id", "text", "source").collect():
        want[r["doc_id"], r["_source"]] += r["taken"]
    assert words == +want and sum(words.values()) > 0 and mixed.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())
    last = by["byte bpe"](spark, mixed, "")
    assert len(set(last.columns)) == len(last.columns) and {"a.b", "n_tokens", "bpe_offsets"} <= set(last.columns)
    assert last.where("not round_trip").isEmpty() and last.count() == mixed.count()


def test_copies_of_one_row_share_what_the_mix_takes(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(1, text, "a", k) for k in range(5)] + [(9, text + " x", "b", k) for k in range(2)], "doc_id long, text string, source string, lang int")
    taken = mixing._taken(docs, "doc_id", "text", "source").groupBy("doc_id").sum("taken").collect()
    got = Counter()
    for r in mixing.mixed_documents(docs).collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert got == {r[0]: r[1] for r in taken if r[1]}
