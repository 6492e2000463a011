"""k-means over integer vectors with Hamerly's bounds, exact to the last unit.

Vectors are floor(scale * x), in blocks. A table holds the blocks; a second one, written anew each round, holds per
vector its cluster, an upper bound of the distance to its centroid and a lower bound of that to the second nearest. Both
are bucketed by the block's id, so that they meet without a shuffle. Between rounds bounds are loosened by how far centroids moved; a
vector whose upper bound is below its lower one, or below half the way to the nearest other centroid, keeps its
cluster without a look at it. The others are ambiguous and get full scans in exact integers. Bounds are rounded
outwards, so a vector is only passed over if it is strictly nearest. What leaves a round per block is the sums of the vectors that
moved; they are added up by treeAggregate, as whole numbers of any size.

Defined results: vectors that are null, of another length, or hold null or non-finite components take no part; vectors
with a null vec_id are clustered but start no centroid while others can; of rows with the same vec_id each counts;
equal distances go to the smaller number; fewer vectors than centroids give as many centroids as vectors; a distance
or sum beyond a long is null; no vectors give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import lean, partitions, shared_dir, stored

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Vectors of a block.
BLOCK = 1024
#: Below this sums of products of 64 components are exact in doubles.
SMALL = 1 << 22

_STATE = "block long, cluster binary, upper binary, lower binary, moved string"


def usable(c: Column, dimensions: int = DIMENSIONS) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.coalesce((F.size(c) == dimensions) & F.forall(c, fine), F.lit(False))


def _integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, or as Python's integers where those would not be exact."""
    big = np.floor(x.astype(np.float64) * scale)
    return big if np.isfinite(big).all() else np.vectorize(lambda v: math.floor(scale * _ratio(v)), otypes=[object])(x.astype(np.float64))


def _ratio(v: float):
    from fractions import Fraction

    return Fraction(v)


def _packed(v: np.ndarray) -> bytes:
    """i4, f8 or text, by the size of the values."""
    if v.dtype == object:
        return b"t" + " ".join(map(str, v.ravel())).encode()
    return b"i" + v.astype("<i4").tobytes() if np.abs(v).max(initial=0) < SMALL else b"f" + v.astype("<f8").tobytes()


def _unpacked(b: bytes, dimensions: int) -> np.ndarray:
    """Doubles if all are small, else Python's integers."""
    if b[:1] == b"i":
        return np.frombuffer(b, "<i4", offset=1).reshape(-1, dimensions).astype(np.float64)
    out = map(int, b[1:].split()) if b[:1] == b"t" else map(int, np.frombuffer(b[1:], "<f8"))
    return np.array(list(out), object).reshape(-1, dimensions)


def scanned(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of vectors to centroids, exact."""
    if v.dtype != object and all(abs(x) < SMALL for c in centroids for x in c):
        c = np.array(centroids, np.float64)
        return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    c, v = np.array(centroids, object), v if v.dtype == object else v.astype(np.int64).astype(object)
    return np.array([[((x - y) ** 2).sum() for y in c] for x in v], object).reshape(len(v), len(c))


def _rooted(d2: np.ndarray, to: float) -> np.ndarray:
    """The roots of whole numbers, rounded away in the direction of ``to``; what has no double is bounded by it."""
    try:
        return np.nextafter(np.nextafter(np.sqrt(d2.astype(np.float64)), to), to)
    except OverflowError:
        return np.full(d2.shape, max(to, 0.0))


class Round:
    """What all blocks need of the centroids, and of those before."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None = None) -> None:
        self.centroids, self.before = centroids, before
        now, k = np.array(centroids, object), len(centroids)
        between = np.array([[((x - y) ** 2).sum() for y in now] for x in now], object).reshape(k, k)
        apart = _rooted(between, -math.inf).astype(np.float64)
        np.fill_diagonal(apart, math.inf)
        self.half = np.nextafter(apart.min(1) / 2, -math.inf)
        if before is not None:
            drift = _rooted(np.array([((x - y) ** 2).sum() for x, y in zip(now, np.array(before, object), strict=True)], object), math.inf).astype(np.float64)
            drift[[x == y for x, y in zip(centroids, before, strict=True)]] = 0
            self.drift = drift
            self.others = np.array([np.delete(drift, j).max(initial=0) for j in range(k)])

    def assign(self, v: np.ndarray, cluster: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The clusters and bounds of a block, and which of its vectors were scanned."""
        n, k = len(v), len(self.centroids)
        if cluster is None:
            cluster, upper, lower = np.zeros(n, np.int32), np.full(n, math.inf), np.full(n, -math.inf)
        else:
            upper = np.nextafter(upper + self.drift[cluster], math.inf)
            lower = np.nextafter(lower - self.others[cluster], -math.inf)
        open_ = np.flatnonzero(~(upper < np.maximum(lower, self.half[cluster])))
        if len(open_):
            d2 = scanned(v[open_], self.centroids)
            best = d2.argmin(1)
            rows = np.arange(len(open_))
            cluster[open_], upper[open_] = best, _rooted(d2[rows, best], math.inf)
            if k > 1:
                rest = d2.astype(object) if d2.dtype == object else d2.copy()
                rest[rows, best] = d2.max(1) + 1  # only the second is looked for
                lower[open_] = _rooted(rest.min(1), -math.inf) if d2.dtype != object else -math.inf
            else:
                lower[open_] = math.inf
        return cluster, upper, lower, open_


def _sums(v: np.ndarray, cluster: np.ndarray, sign: int, into: dict[str, list[int]]) -> None:
    for j in np.unique(cluster):
        mine = v[cluster == j]
        total = [len(mine), *(int(x) for x in mine.sum(0))]
        into[str(j)] = [a + sign * b for a, b in zip(into.get(str(j), [0] * len(total)), total, strict=True)]


def _added(a: dict[str, list[int]], b: dict[str, list[int]]) -> dict[str, list[int]]:
    return a | {j: [x + y for x, y in zip(a[j], s, strict=True)] if j in a else s for j, s in b.items()}


class _Tables:
    """Tables below the shared folder, bucketed by block."""

    def __init__(self, spark, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.names: list[str] = []

    def put(self, df: DataFrame, dealt: bool = False) -> DataFrame:
        """df as a table; dealt: its rows lie by bucket already."""
        name = f"loomline_{uuid.uuid4().hex}"
        rows = df if dealt else df.repartition(self.buckets, "block")
        path = f"{shared_dir(self.spark)}/loomline/{name}"
        rows.write.bucketBy(self.buckets, "block").sortBy("block").option("path", path).saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def drop(self, name: str) -> None:
        """An outside table's files go with it."""
        sc = self.spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(self.spark)}/loomline/{name}")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def blocks(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(block, ids, vectors): up to BLOCK vectors a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for b in batches:
            v = _integers(b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions), scale)
            for at in range(0, len(v), BLOCK):
                yield pa.RecordBatch.from_pylist([{"block": block, "ids": b.column(0).slice(at, BLOCK).to_pylist(), "vectors": _packed(v[at : at + BLOCK])}], schema=out)
                block += 1

    out = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])
    return rows.select("vec_id", "embedding").mapInArrow(lean(run), "block long, ids array<long>, vectors binary")


def clustered(rows: DataFrame, salt: str = "3", k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each usable row of (vec_id, embedding)."""
    spark = rows.sparkSession
    kept = rows.where(usable(F.col("embedding"), dimensions)).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(order.asc_nulls_last(), "embedding").limit(k).collect()  # k rows
    centroids = [[int(x) for x in v] for v in (_integers(np.array([r.embedding]), scale)[0] for r in starts)]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

    tables = _Tables(spark, partitions(spark))
    base = tables.put(blocks(kept, dimensions, scale))
    state, before, totals = None, None, {}
    for turn in range(rounds + 1):
        here = Round(centroids, before)

        def assign(batches: Iterator[pa.RecordBatch], here: Round = here) -> Iterator[pa.RecordBatch]:
            out = pa.schema([("block", pa.int64()), ("cluster", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("moved", pa.string())])
            for b in batches:
                for r in b.to_pylist():
                    v, moved = _unpacked(r["vectors"], dimensions), {}
                    old = np.frombuffer(r["cluster"], "<i4").copy() if r.get("cluster") is not None else None
                    new, upper, lower, _ = here.assign(v, old.copy() if old is not None else None, *((np.frombuffer(r[x], "<f8").copy() for x in ("upper", "lower")) if old is not None else (None, None)))
                    at = np.flatnonzero(old != new) if old is not None else np.arange(len(v))
                    if old is not None:
                        _sums(v[at], old[at], -1, moved)
                    _sums(v[at], new[at], 1, moved)
                    yield pa.RecordBatch.from_pylist([{"block": r["block"], "cluster": new.astype("<i4").tobytes(), "upper": upper.astype("<f8").tobytes(), "lower": lower.astype("<f8").tobytes(), "moved": json.dumps(moved) if moved else None}], schema=out)

        joined = base.select("block", "vectors") if state is None else base.select("block", "vectors").join(state.hint("merge").drop("moved"), "block")
        state = tables.put(joined.mapInArrow(lean(assign), _STATE), dealt=True)
        if len(tables.names) > 2:
            tables.drop(tables.names.pop(1))
        if turn < rounds:
            moved = state.where("moved IS NOT NULL").select("moved").rdd.treeAggregate({}, lambda a, r: _added(a, json.loads(r.moved)), _added)
            totals = _added(totals, moved)
            before = centroids
            centroids = [[s // totals[str(j)][0] for s in totals[str(j)][1:]] if totals.get(str(j), [0])[0] else c for j, c in enumerate(centroids)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v, cluster = _unpacked(r["vectors"], dimensions), np.frombuffer(r["cluster"], "<i4")
                d = np.zeros(len(v), object)
                for j in np.unique(cluster):
                    d[cluster == j] = [int(x) for x in scanned(v[cluster == j], [centroids[j]])[:, 0]]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(cluster, pa.int32()), pa.array([x if x < 1 << 63 else None for x in d], pa.int64())], ["vec_id", "cluster", "distance"])

    found = stored(base.join(state.hint("merge").select("block", "cluster"), "block").mapInArrow(lean(measure), "vec_id long, cluster int, distance long"))
    for name in tables.names:
        tables.drop(name)
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)")))
    inertia = {r.cluster: r.total for r in found.groupBy("cluster").agg(total.alias("total")).collect()}  # k rows
    long = lambda x: int(x) if x is not None and x < 1 << 63 else None
    whole = long(sum(inertia.values())) if None not in inertia.values() else None
    about = [(j, long(inertia[j]), whole, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids) if j in inertia]
    return found.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
