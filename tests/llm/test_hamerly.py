"""Centroids: equal to plain integer k-means, whatever the values; bounds only pass over what can't change."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
from loomline.llm import hamerly

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, salt="3", k=8, rounds=10, dimensions=64, scale=1024):
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"{salt}:{i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        at = nearest()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, x) in zip(kept, at, strict=True) if x == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    at = nearest()
    each = [sum(d for d, x in at if x == j) for j in range(len(centroids))]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long(d), long(each[j]), long(sum(each)), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True)), key=repr)


def got(spark, rows, schema=SCHEMA, **more):
    return sorted((tuple(r) for r in hamerly.clustered(spark.createDataFrame(rows, schema).repartition(3), **more).collect()), key=repr)


def test_equal_to_brute_force(spark):
    r = random.Random(1)
    centres = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [r.gauss(c, 0.3) for c in centres[i % 6]]) for i in range(400)]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [None] + [1.0] * 63), (1004, [math.nan] + [1.0] * 63), (1005, [math.inf] + [1.0] * 63)]
    rows += [(5, rows[5][1]), (5, [0.0] * 64), (None, [0.5] * 64), (None, [0.5] * 64)]  # repeated and null ids
    rows += [(2000 + i, [0.25] * 64) for i in range(200)]  # a third are copies
    assert got(spark, rows) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x), 0.0]) for i, x in enumerate([-4, 4, 0, 0, 0, 2, -2, 1, -1, 3])]
    for salt in "abc":
        assert got(spark, rows, salt=salt, k=3, dimensions=2, scale=1, rounds=3) == brute(rows, salt, 3, 3, 2, 1)


def test_values_beyond_doubles(spark):
    rows = [(i, [float(x), float(-x)]) for i, x in enumerate([1e300, 1e300, 2e300, 1e308, 5.0, 6.0, 1e18, 3e15, 1e7, -1e9])]
    want = brute(rows, k=3, dimensions=2)
    assert got(spark, rows, k=3, dimensions=2) == want and any(r[2] is None for r in want)


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert got(spark, rows, dimensions=2) == brute(rows, dimensions=2)
    assert got(spark, rows[:1], dimensions=2) == brute(rows[:1], dimensions=2)
    assert got(spark, [], dimensions=2) == [] and got(spark, [(None, None)]) == []
    assert got(spark, [(None, [1.0, 2.0])], dimensions=2) == brute([(None, [1.0, 2.0])], dimensions=2)


def test_other_columns(spark):
    rows = [(i, [float(i % 5), 1.0], i, "x", b"y") for i in range(20)]
    assert got(spark, rows, SCHEMA + ", cluster int, block string, vectors binary", dimensions=2, k=3) == brute([r[:2] for r in rows], dimensions=2, k=3)


def test_bounds_pass_over_most_vectors():
    """After the centroids have settled, few vectors are scanned; none of those passed over would have changed."""
    r = np.random.default_rng(2)
    v = np.floor(1024 * (r.normal(size=(8, 64))[r.integers(0, 8, 2000)] + 0.1 * r.normal(size=(2000, 64))))
    centroids = [[int(x) for x in row] for row in v[:8]]
    before, state, scans = None, (None, None, None), []
    for _ in range(6):
        here = hamerly.Round(centroids, before)
        cluster, upper, lower, open_ = here.assign(v, *state)
        exact = hamerly.scanned(v, centroids)
        assert (cluster == exact.argmin(1)).all()
        near = np.sqrt(exact[np.arange(len(v)), cluster])
        assert (upper >= near).all() and (lower <= np.sqrt(np.partition(exact, 1, axis=1)[:, 1])).all()
        state, before = (cluster, upper, lower), centroids
        centroids = [[int(x) for x in v[cluster == j].sum(0) // max(1, (cluster == j).sum())] if (cluster == j).any() else c for j, c in enumerate(centroids)]
        scans.append(len(open_))
    assert scans[0] == 2000 and scans[-1] < 200
