import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomline.llm import simhash
from loomline.llm.simhash import Scheme


def brute_fp(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    s = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    low = {i: i for i in ids}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for x, i in enumerate(ids):
        for y, j in enumerate(ids[:x]):
            if (fps[x] ^ fps[y]).bit_count() <= distance:
                a, b = root(i), root(j)
                low[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_group_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["Ab", "c", "dé", "É", "ee", "f\x0bg", "x" * 9, " q"]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "A"), (4, "a"), (5, "a b")]
    for i in range(6, 160):
        if i > 30 and rng.random() < 0.5:
            words = rows[rng.randrange(6, i)][1].split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    fps = [brute_fp(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], fps, 3)
    assert got == {i: (f"{f:016x}", comps[i]) for (i, _), f in zip(rows, fps, strict=True)}


def test_links_in_hot_buckets(spark):
    """A cloud of close fingerprints, dealt again where more than the limit share a bucket, loses no link."""
    rng = random.Random(4)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 400:
        f = rng.choice(list(fps))
        for _ in range(rng.randrange(1, 5)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "rep long, f0 long")
    want = brute_components(list(range(len(fps))), fps, 3)
    for limit in (2048, 5):
        got = {r.node: r.component for r in simhash.components(simhash.links(classes, Scheme(limit=limit))).collect()}
        assert {i: got.get(i, i) for i in want} == want


def test_near_copies_and_empty(spark):
    rng = random.Random(9)
    words = ["w%d" % i for i in range(3000)]
    docs = [[rng.choice(words) for _ in range(200)] for _ in range(40)]
    rows = [(i, " ".join(d), "k") for i, d in enumerate(docs)]
    for i, d in enumerate(docs[:20]):
        d = list(d)
        d[rng.randrange(200)] = "changed"
        rows.append((100 + i, " ".join(d), "k"))
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(40)) <= ids and len(ids - set(range(40))) <= 1
    assert simhash.report(df.limit(0)).count() == 0
    assert simhash.deduplicated(df.limit(0)).count() == 0


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(words)), n):
        out[at] = "new%d" % rng.randrange(10**9)
    return out


def test_documents_below_the_similarity_stay(spark):
    """Pairs at a similarity of 0.7 to 0.79, and pairs that share one much repeated line only, are no near copies."""
    rng = random.Random(5)
    docs = []
    while len(docs) < 240:
        a = ["w%d" % rng.randrange(5000) for _ in range(200)]
        b = changed(rng, a, rng.randrange(5, 9))
        if 0.7 <= jaccard(a, b) < 0.79:
            docs += [a, b]
    line = ["all", "of", "us", "say", "the", "same", "line"]
    docs += [[*line * 60, *("v%d" % rng.randrange(5000) for _ in range(80))] for _ in range(6)]
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs)))


def test_all_pairs_just_above_the_similarity_are_linked(spark):
    """Pairs at a similarity of 0.8 to 0.83; with small blocks, in one chained cluster, against brute force."""
    rng = random.Random(6)
    docs = []
    while len(docs) < 600:
        a = ["w%d" % rng.randrange(5000) for _ in range(200)]
        b = changed(rng, a, rng.randrange(4, 6))
        if 0.8 <= jaccard(a, b) < 0.83:
            docs += [a, b]
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(df).collect()} == set(range(0, 600, 2))
    assert simhash.NEAR.recall(0.8) > 0.9998
    docs = docs[:1]
    while len(docs) < 60:
        docs.append(changed(rng, docs[rng.randrange(len(docs))], rng.choice((1, 3, 6))))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    low = list(range(60))
    for _ in range(60):
        for i in range(60):
            for j in range(i):
                if low[i] != low[j] and jaccard(docs[i], docs[j]) >= 0.8:
                    low[i] = low[j] = min(low[i], low[j])
    members = df.select("doc_id", F.lit(0).cast("long").alias("cluster"))
    for block in (256, 5):
        got = {r.node: r.component for r in simhash.components(simhash.similar(df, members, simhash.Near(block=block))).collect()}
        assert [got.get(i, i) for i in range(60)] == low and 2 < len(set(low)) < 59


def test_near_copies_are_linked_by_fingerprints(spark):
    """Where bands of minima can't meet, near copies whose fingerprints differ in up to 3 bits go all the same; others stay."""
    rng = random.Random(8)
    docs = [["w%d" % rng.randrange(5000) for _ in range(3000)] for _ in range(12)]
    docs += [changed(rng, d, 1) for d in docs]
    near = simhash.Near(bands=1, rows=2000)
    prints = [int(simhash.fingerprint(" ".join(d), near.scheme)[0]) for d in docs]
    gone = {12 + i for i in range(12) if (prints[i] ^ prints[12 + i]).bit_count() <= 3}
    assert len(gone) > 3
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(df, near).collect()} == set(range(24)) - gone
