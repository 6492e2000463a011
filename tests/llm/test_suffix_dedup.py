import hashlib
import random

import numpy as np

from loomline.llm import suffix_dedup

W = suffix_dedup.WINDOW


def brute(rows):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - W + 1):
            first[data[i : i + W]] = min(doc, first.get(data[i : i + W], doc))
    out = {}
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - W + 1):
            if first[data[i : i + W]] < doc:
                gone[i : i + W] = [True] * W
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(5, 40))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 400), (5, "y" * 70000), (6, "y" * 70001), (7, "\0" * 60 + "a"), (8, "\0" * 61)]
    for i in range(9, 150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            k = rng.randrange(4)
            parts.append(p if k == 0 else p[rng.randrange(len(p)) :] if k == 1 else p[: rng.randrange(1, len(p))] if k == 2 else " ".join(word() for _ in range(20)))
        rows.append((i * 7 % 1009 + 10, " ".join(parts)))
    rows += [(5000 + i, rows[20][1]) for i in range(5)]
    return rows


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df).collect()}
    assert got == brute(rows)


def test_levels(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(suffix_dedup, "_BATCH", 40)
    rows = [(d, bytes(rng.integers(97, 99, 120, dtype=np.uint8))) for d in range(20)]
    rows += [(100 + d, rows[d][1][5:80] + b"\0" * 30) for d in range(20)]
    of, place = suffix_dedup._matched(np.array([d for d, _ in rows]), [t for _, t in rows])
    first = {}
    for d, t in rows:
        for i in range(len(t) - W + 1):
            first.setdefault(t[i : i + W], d)
    want = {(k, i) for k, (d, t) in enumerate(rows) for i in range(len(t) - W + 1) if first[t[i : i + W]] < d}
    assert set(zip(of.tolist(), place.tolist(), strict=True)) == want
    levels = suffix_dedup.SuffixLevels()
    for d in range(64):
        levels.add(rng.integers(0, 256, 10 * W, dtype=np.uint8), np.arange(10) * W, np.full(10, d))
    assert len(levels.levels) <= 7
    for x in levels.levels:
        assert (np.diff(np.argsort(x.windows(), kind="stable")) == 1).all()


def test_hot_anchor_is_split(spark):
    """A passage between different words in many documents: many different segments with one anchor."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 70)))
    rows = [(i, word() + "this very common passage stands in all of the documents, with an end" + word()) for i in range(2300)]
    rows += [(2900 + i, rng.choice(rows)[1][rng.randrange(30) :]) for i in range(100)] + [(5, rows[5][1])]
    got = [tuple(r)[:5] for r in suffix_dedup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    want = brute(rows)
    assert sorted(got) == sorted((d, *want[d]) for d, _ in rows)


def test_columns_nulls_and_empty(spark):
    p = "passage é " * 9
    df = spark.createDataFrame([(1, p, None, 1), (2, "a " + p + " b", "en", 2), (None, p, "en", 3), (3, None, None, 4)], "doc_id long, text string, _of string, count int")
    out = suffix_dedup.deduplicated(df)
    assert out.columns == df.columns
    got = {r["count"]: r.text for r in out.collect()}
    assert got[1] == p and got[3] == p and got[4] is None and len(got[2]) < 10
    assert suffix_dedup.report(df.limit(0)).count() == 0 == suffix_dedup.deduplicated(df.limit(0)).count()
