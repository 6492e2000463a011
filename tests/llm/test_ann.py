import math

import numpy as np

from loomline.llm import ann


def brute(rows, k=10, every=100):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            near = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
            out[q] = near
    return out


def test_recall_and_edges(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 12] + 0.4 * rng.normal(size=8)]) for i in range(1500)]
    rows += [(i, rows[3][1]) for i in range(2000, 2600)]  # a hot vector, queries among its copies
    rows += [(3000, None), (3001, [0.0] * 8), (3100, [float("nan")] + [1.0] * 7), (3200, [1.0] * 7), (3300, [None] + [1.0] * 7), (None, [1.0] * 8), (3400, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, query_id string")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = total = 0
    for q, near in want.items():
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        for _, i, s in mine:
            v = dict(rows)
            assert abs(s - math.dist(v[q], v[i])) < 1e-9
        hits += len({i for _, i in near} & {i for _, i, _ in mine})
        total += len(near)
    assert hits / total >= 0.9
    hot = [i for _, i, _ in sorted(got[2000])]
    assert hot == [3, *range(2001, 2010)]
    assert ann.search(df.limit(0)).count() == 0
    assert len(ann.search(df.where("vec_id < 1 or vec_id = 5")).collect()) == 1


def test_tree_first_leaf():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 6))
    tree = ann.fit(x)
    leaf = tree.leaf_of(x[:50])
    for v, n in zip(x[:50], leaf, strict=True):
        order = list(tree.leaves_by_promise(v))
        assert order[0] == n and len(order) == len(set(order)) == sum(not c for c in tree.children)


def test_one_id_with_two_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)] + [(i, [float(x) for x in rng.normal(size=4)]) for i in range(10)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, every=30).collect()
    for q in (0, 30):
        near = {}
        for a in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(a) - np.array(v)) ** 2).sum()))
                    near[i] = min(near.get(i, d), d)
        want = sorted((d, i) for i, d in near.items())[:5]
        assert [(r.vec_id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, n + 1) for n, (_, i) in enumerate(want)]
