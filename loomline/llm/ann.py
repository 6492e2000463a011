"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample (``SAMPLE`` distinct vectors) and broadcast; every row is indexed by
descent. Queries traverse it best bin first: a priority queue of nodes by distance to their centres yields leaves
in order of promise. How many leaves are visited is calibrated: for up to ``PROBES`` vectors, other than the queries
where there are enough, the exact neighbours over all rows are found by a scan, and visits are widened until ``TARGET``
of them lie in visited leaves. A query goes on until the leaves visited have k + 1 classes.

Equal vectors are one class, which keeps its ``k + 1`` smallest ids: no more of them can be among anyone's nearest.
A class's queries search once. Small leaves are compared together, large ones are dealt to blocks, and many queries of
a group to parts; a query gives one short list per group, whatever the leaves in it.

Defined results: vectors that are null, zero, of another length than the most common one, or hold null or
non-finite components take no part, as query or candidate; rows with a null vec_id neither; repeated vec_ids
with the same vector count once; a vec_id with several vectors counts, as query and as candidate, at the smallest
distance of any of them; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table gives
none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import lean, partitions, stored

SAMPLE, BRANCH, LEAF_SAMPLE, PROBES, TARGET = 16_384, 12, 48, 100, 0.97
#: Rows, and queries, that are compared together, about.
_BLOCK, _QUERIES = 20_000, 4_000


@dataclass
class Tree:
    centres: np.ndarray  # of all nodes
    children: list[list[int]]  # of each node; none for a leaf

    def leaf_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf that each vector descends to."""
        at = np.zeros(len(vectors), np.int64)
        todo = {0}
        while todo:
            node = todo.pop()
            if self.children[node]:
                rows = np.flatnonzero(at == node)
                kids = np.array(self.children[node])
                at[rows] = kids[_distances(vectors[rows], self.centres[kids]).argmin(1)]
                todo |= set(self.children[node])
        return at

    def leaves_by_promise(self, query: np.ndarray) -> Iterator[int]:
        """Best bin first. The first leaf is the one that the query itself descends to."""
        queue = [(0.0, 0)]
        node = 0
        while queue:
            _, node = heapq.heappop(queue)
            while self.children[node]:  # down to a leaf, the siblings wait
                kids = self.children[node]
                d = _distances(query[None], self.centres[kids])[0]
                best = int(d.argmin())
                for i, kid in enumerate(kids):
                    if i != best:
                        heapq.heappush(queue, (float(d[i]), kid))
                node = kids[best]
            yield node


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, by products."""
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None], 0)


def fit(sample: np.ndarray, branch: int = BRANCH, least: int = LEAF_SAMPLE, seed: int = 8) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(sample.mean(0, keepdims=True) if len(sample) else np.zeros((1, sample.shape[1])), [[]])
    centres = [tree.centres[0]]
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= least * 2:
            continue
        x = sample[rows]
        c = x[rng.permutation(len(x))[:branch]]
        for _ in range(8):
            of = _distances(x, c).argmin(1)
            kept = np.unique(of)
            c = np.array([x[of == k].mean(0) for k in kept])
        of = _distances(x, c).argmin(1)
        parts = [rows[of == k] for k in range(len(c))]
        if max(map(len, parts)) == len(rows):
            continue
        for k, part in enumerate(parts):
            centres.append(c[k])
            tree.children.append([])
            tree.children[node].append(len(centres) - 1)
            todo.append((len(centres) - 1, part))
    tree.centres = np.array(centres)
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (doubles) of the rows that take part."""
    v = F.col("embedding")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x.cast("double")).alias("vec"))
    size = rows.groupBy(F.size("vec").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    return rows.where(F.size("vec") == (size[0] if size else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors))
    few = Window.partitionBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    some = rows.distinct().withColumn("nth", F.row_number().over(few)).where(F.col("nth") <= k + 1)
    classes = some.groupBy("vec").agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "vec", "ids"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec").distinct()
    queries = stored(queries.join(classes.select("cid", "vec"), "vec").select("query_id", "cid", "vec"))
    asked = stored(queries.groupBy("cid").agg(F.first("vec").alias("vec")))

    sample = np.array([r[0] for r in classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").collect()])
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(fit(sample))  # at most SAMPLE / LEAF_SAMPLE leaves and the nodes above

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaf_of(_matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], ["leaf", "cid", "vec", "ids"])

    index = stored(classes.mapInArrow(lean(indexed), "leaf long, cid long, vec array<double>, ids array<long>"))
    others = classes.select("cid", "vec").join(asked.select("cid"), "cid", "left_anti").select("vec", F.lit(0).alias("late"))
    visits = _calibrated(index, others.unionByName(asked.select("vec", F.lit(1).alias("late"))), shared.value, k)
    sizes = sorted((r[0], r[1]) for r in index.groupBy("leaf").count().collect())  # one row per leaf of the tree
    groups, room = [], 0
    for leaf, n in sizes:  # small leaves share a group of about _BLOCK rows, a large one has its own, in blocks
        if not groups or n > room:
            room = max(_BLOCK, n)
            groups.append((leaf, (groups[-1][1] + 1) if groups else 0, -(-n // _BLOCK)))
        else:
            groups.append((leaf, groups[-1][1], groups[-1][2]))
        room -= n
    group_of = {leaf: g for leaf, g, _ in groups}
    rows_of = dict(sizes)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for b in batches:
            group: list[int] = []
            leaves: list[list[int]] = []
            at: list[int] = []
            for i, q in enumerate(_matrix(b.column(1))):
                mine: dict[int, list[int]] = {}
                have = 0
                for nth, leaf in enumerate(tree.leaves_by_promise(q)):
                    if nth >= visits and have > k:
                        break
                    if leaf in group_of:
                        mine.setdefault(group_of[leaf], []).append(leaf)
                        have += rows_of[leaf]
                group += mine
                leaves += mine.values()
                at += [i] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), pa.array(leaves, pa.list_(pa.int64())), *(c.take(pa.array(at, pa.int64())) for c in b.columns)], ["group", "leaves", "cid", "vec"])

    dealt = asked.select("cid", "vec").repartition(partitions(spark), "cid")
    sent = stored(dealt.mapInArrow(lean(routed), "group int, leaves array<long>, cid long, vec array<double>"))
    asking = {r[0]: r[1] for r in sent.groupBy("group").count().collect()}  # one row per group of leaves
    parts = {g: -(-n // _QUERIES) for g, n in asking.items()}
    deal = F.broadcast(spark.createDataFrame([(leaf, g, n, parts.get(g, 0)) for leaf, g, n in groups], "leaf long, group int, blocks int, parts int"))
    blocks = F.broadcast(spark.createDataFrame([(g, n, parts.get(g, 0)) for g, n in {g: n for _, g, n in groups}.items()], "group int, blocks int, parts int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sent = sent.join(blocks, "group").select("group", F.pmod(F.xxhash64("cid"), "parts").cast("int").alias("part"), each("blocks").alias("block"), F.col("cid").alias("query"), "vec", "leaves")
    base = index.join(deal, "leaf").where("parts > 0").select("group", each("parts").alias("part"), F.pmod(F.xxhash64("cid"), "blocks").cast("int").alias("block"), "leaf", "cid", "vec", "ids")

    def compared(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(base) and len(queries):
            x = np.stack(base["vec"].to_numpy())
            ids = base["ids"].to_numpy()
            names, leaf = np.unique(base["leaf"].to_numpy(), return_inverse=True)
            for at in range(0, len(queries), 128):
                part = queries.iloc[at : at + 128]
                q = np.stack(part["vec"].to_numpy())
                visited = np.array([np.isin(names, leaves) for leaves in part["leaves"]])
                for query, vec, near in zip(part["query"], q, _nearest(q, x, k + 1, visited[:, leaf]), strict=True):
                    d = np.sqrt(((x[near] - vec) ** 2).sum(1))
                    out += [(query, v, s) for s, n in zip(d, near, strict=True) for v in ids[n]]
        return pd.DataFrame(out, columns=["query", "vec_id", "score"]).astype({"query": "int64", "vec_id": "int64", "score": "float64"})

    found = base.groupBy("group", "part", "block").cogroup(sent.groupBy("group", "part", "block")).applyInPandas(compared, "query long, vec_id long, score double")
    order = lambda key: Window.partitionBy(key).orderBy("score", "vec_id")
    near = found.withColumn("nth", F.row_number().over(order("query"))).where(F.col("nth") <= k + 1)
    each = queries.select("query_id", F.col("cid").alias("query")).join(near, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = each.withColumn("rank", F.row_number().over(order("query_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _nearest(q: np.ndarray, x: np.ndarray, k: int, allowed: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the (allowed) rows of x that can be among its k nearest: up to the k-th distance, with room for rounding."""
    d = _distances(q, x)
    if allowed is not None:
        d = np.where(allowed, d, np.inf)
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    room = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
    return [np.flatnonzero((row <= e) & np.isfinite(row)) for row, e in zip(d, edge + room, strict=True)]


def _calibrated(index: DataFrame, vectors: DataFrame, tree: Tree, k: int) -> int:
    """How many leaves a query visits: the fewest that hold TARGET of the probes' exact nearest rows; probes are taken from late vectors last."""
    probes = vectors.orderBy("late", F.xxhash64("vec")).limit(PROBES).collect()
    if not probes:
        return 1
    q = np.array([r["vec"] for r in probes])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            if not len(x):
                continue
            near = _nearest(q, x, k + 1)
            at = np.concatenate(near)
            of = np.repeat(np.arange(len(q)), [len(n) for n in near])
            d = ((x[at] - q[of]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(of), b.column(0).take(pa.array(at)), pa.array(d), b.column(2).take(pa.array(at))], ["probe", "leaf", "d", "n"])

    rows = index.select("leaf", "vec", F.size("ids").alias("n")).mapInArrow(lean(scanned), "probe long, leaf long, d double, n int")
    nth = F.row_number().over(Window.partitionBy("probe").orderBy("d", "leaf"))
    best = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("probe", "leaf").collect()  # PROBES x (k + 1) rows at most
    place = [{leaf: i for i, leaf in enumerate(tree.leaves_by_promise(v))} for v in q]
    needed = np.sort([place[r["probe"]][r["leaf"]] for r in best]) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))])
