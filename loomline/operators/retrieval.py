"""Vector retrieval: exact, over all vectors or over an index of inverted lists, and prompts from what is found.

Queries go to the vectors, not vectors to the queries: a block of queries is broadcast, each batch of vectors is compared
with it by matrix products, and only the best of each batch leave. An index keeps vectors in lists, one partition
of a stored table each; a search reads the partitions that it probes.

Vectors that are null, hold null or non-finite components, or have another length than the first query take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.sources.tables import stored

#: Queries in one broadcast, and pairs of a query and a list that it probes.
MOST_QUERIES, MOST_PROBES = 10_000, 500_000
#: Lists of an index at most, and vectors for each list that centroids are fitted on.
MOST_LISTS, FITTED = 4096, 256


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def usable(c: Column, dimensions: int | None = None) -> Column:
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & (F.size(c) > 0)
    return F.coalesce(fine if dimensions is None else fine & (F.size(c) == dimensions), F.lit(False))


def nearest(corpus: DataFrame, queries: DataFrame, k: int = 3, digits: int = 6) -> DataFrame:
    """(query_id, vec_id, distance, rank): exact, over the whole corpus; ties to the smaller vec_id, the query's own row left out.

    Many queries go in blocks, each with a pass over the corpus.
    """
    q = stored(queries.where(usable(F.col("embedding"))).select("vec_id", "embedding"))
    blocks = max(1, -(-q.count() // MOST_QUERIES))
    out = None
    for i in range(blocks):
        part = _compared(corpus, q.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i), k, digits)
        out = part if out is None else out.unionByName(part)
    return _ranked(out, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _compared(corpus: DataFrame, queries: DataFrame, k: int, digits: int, probed: str | None = None) -> DataFrame:
    """(query_id, vec_id, distance): the best k of each batch of vectors, and what is as near, for each query.

    With probed, queries have an array of lists of that name, and vectors a ``list``; only those meet.
    """
    spark = corpus.sparkSession
    rows = queries.collect()  # a bounded block
    if not rows:
        return spark.createDataFrame([], "query_id long, vec_id long, distance double")
    ids, q = np.array([r["vec_id"] if r["vec_id"] is not None else -1 for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64)
    of: dict[int, np.ndarray] = {}
    if probed:
        at, to = np.repeat(np.arange(len(rows)), [len(r[probed]) for r in rows]), np.concatenate([np.array(r[probed], np.int64) for r in rows])
        order = np.argsort(to, kind="stable")
        names, starts = np.unique(to[order], return_index=True)
        of = dict(zip(names.tolist(), np.split(at[order], starts[1:]), strict=True))
    shared = spark.sparkContext.broadcast((ids, q, of))
    slack = 2.0 * 10.0**-digits

    def best(v_ids: np.ndarray, v: np.ndarray, ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        norms = (v * v).sum(1)
        for at in range(0, len(q), 256):
            block = q[at : at + 256]
            d = norms + (block * block).sum(1)[:, None] - 2 * block @ v.T
            d[ids[at : at + 256, None] == v_ids] = np.inf
            bound = np.partition(d, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
            i, j = np.nonzero((d <= (bound + slack + 1e-9 * np.abs(bound))[:, None]) & np.isfinite(d))
            yield ids[at + i], v_ids[j], ((block[i] - v[j]) ** 2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, of = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v_ids = b.column(0).to_numpy(zero_copy_only=False)
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            if probed:
                lists = b.column(2).to_numpy()
                groups = [(np.flatnonzero(lists == x), of[x]) for x in np.unique(lists) if x in of]
            else:
                groups = [(np.arange(len(v)), np.arange(len(q)))]
            for mine, asked in groups:
                for found in best(v_ids[mine], v[mine], ids[asked], q[asked]):
                    yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "distance"])

    vectors = corpus.where(usable(F.col("embedding"), q.shape[1]) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), "embedding", *(["list"] if probed else []))
    return vectors.mapInArrow(run, "query_id long, vec_id long, distance double").withColumn("distance", F.round("distance", digits))


# An index ---------------------------------------------------------------------------------------------------------


def build_index(vectors: DataFrame, path: str, lists: int | None = None, seed: int = 11) -> None:
    """K7, M6: vectors (vec_id, embedding) in inverted lists below path: ``vectors``, partitioned by list, and ``lists`` (list, centroid, radius, n).

    The lists' centroids are fitted by k-means on ``FITTED`` vectors a list, those of the least hashes of vec_id; every usable vector is
    in the list of its nearest centroid. Lists default to the root of the number of vectors. A list of very many vectors is several files.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    first = vectors.where(usable(F.col("embedding"))).select(F.size("embedding")).first()
    rows = vectors.where(usable(F.col("embedding"), first[0] if first else 0) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>"))
    n = rows.count()
    lists = min(MOST_LISTS, lists or max(1, round(n**0.5)))
    share = min(1.0, FITTED * lists / max(n, 1))
    place = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 32)) / float(1 << 32)
    sample = stored(rows.where(place <= share).select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features")))
    centroids = np.zeros((1, first[0] if first else 0))
    if n:
        centroids = np.array(KMeans(k=max(2, lists), maxIter=8, seed=seed).fit(sample).clusterCenters()) if lists > 1 else centroids

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (centroids * centroids).sum(1)
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            at = (norms - 2 * v @ centroids.T).argmin(1) if b.num_rows else np.zeros(0, int)
            far = np.sqrt(((v - centroids[at]) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(far), pa.array(at.astype(np.int32))], ["vec_id", "embedding", "far", "list"])

    placed = rows.mapInArrow(dealt, "vec_id long, embedding array<float>, far double, list int")
    placed.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/vectors")
    about = spark.read.schema("vec_id long, embedding array<float>, far double, list int").parquet(f"{path}/vectors").groupBy("list").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
    about = [(r["list"], [float(x) for x in centroids[r["list"]]], r["radius"], r["n"]) for r in about]
    spark.createDataFrame(about, "list int, centroid array<double>, radius double, n long").coalesce(1).write.parquet(f"{path}/lists")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors with their list, lists)."""
    return spark.read.schema("vec_id long, embedding array<float>, far double, list int").parquet(f"{path}/vectors"), spark.read.schema("list int, centroid array<double>, radius double, n long").parquet(f"{path}/lists")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 3, probes: int | None = 8, digits: int = 6) -> DataFrame:
    """J9, O5 over an index: (query_id, vec_id, distance, rank), as ``nearest`` gives them.

    Each query probes the ``probes`` lists with the nearest centroids, and more until these hold more than k vectors. With None it is
    exact: after the first lists, every list whose centroid and radius leave room for something nearer is probed as well.
    Queries with near lists go in one block, and a block reads only the partitions that it probes.
    """
    vectors, lists = load_index(spark, path)
    about = sorted(lists.collect(), key=lambda r: r["list"])  # at most MOST_LISTS
    if not about:
        return _ranked(spark.createDataFrame([], "query_id long, vec_id long, distance double"), k)
    numbers, sizes = np.array([r["list"] for r in about]), np.array([r["n"] for r in about])
    centroids, radius = np.array([r["centroid"] for r in about]), np.array([r["radius"] for r in about])

    def to_lists(q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((q * q).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * q @ centroids.T), 0))

    @F.pandas_udf("array<int>")
    def first(embedding: pd.Series) -> pd.Series:
        d = to_lists(np.array(embedding.tolist(), np.float64))
        out = []
        for row in np.argsort(d, axis=1, kind="stable"):
            enough = int(np.searchsorted(np.cumsum(sizes[row]), k + 1)) + 1
            out.append(numbers[row[: max(enough, probes or 4)]])
        return pd.Series(out)

    @F.pandas_udf("array<int>")
    def others(embedding: pd.Series, kth: pd.Series, done: pd.Series) -> pd.Series:
        room = to_lists(np.array(embedding.tolist(), np.float64)) - radius - 1e-6
        near = room <= np.sqrt(kth.to_numpy(float))[:, None] * (1 + 1e-9) + 10.0**-digits
        return pd.Series([np.setdiff1d(numbers[x], y) for x, y in zip(near, done, strict=True)])

    good = usable(F.col("embedding"), centroids.shape[1]) & F.col("vec_id").isNotNull()
    asked = stored(queries.where(good).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).withColumn("_lists", first("embedding")))
    found = _probed(vectors, asked, k, digits)
    if probes is None:
        found = stored(found)
        kth = _ranked(found, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("_kth"))
        left = asked.join(kth, F.col("vec_id") == F.col("query_id"), "left").withColumn("_lists", others("embedding", F.coalesce("_kth", F.lit(float("inf"))), "_lists"))
        more = _probed(vectors, stored(left.where(F.size("_lists") > 0).select("vec_id", "embedding", "_lists")), k, digits)
        found = found.unionByName(more)
    return _ranked(found, k)


def _probed(vectors: DataFrame, asked: DataFrame, k: int, digits: int) -> DataFrame:
    """The best of the lists that asked (vec_id, embedding, _lists) names; queries of the same first list stay together."""
    home = F.get("_lists", F.lit(0))
    blocks, room = [[]], 0.0
    for r in asked.groupBy(home.alias("home")).agg(F.count("*").alias("n"), F.sum(F.size("_lists")).alias("probes")).orderBy("home").collect():  # one row a list
        full = max(r["n"] / MOST_QUERIES, r["probes"] / MOST_PROBES)
        parts = int(np.ceil(full))
        if parts > 1:  # more than a block by itself
            blocks = [[(r["home"], i, parts)] for i in range(parts)] + blocks
            continue
        if room + full > 1:
            blocks.append([])
            room = 0.0
        blocks[-1].append((r["home"], 0, 1))
        room += full
    out = None
    for block in blocks:
        if block:
            mine = asked.where(home.isin([h for h, *_ in block]))
            if block[0][2] > 1:
                mine = mine.where(F.pmod(F.xxhash64("vec_id"), F.lit(block[0][2])) == block[0][1])
            lists = [r[0] for r in mine.select(F.explode("_lists").alias("list")).distinct().collect()]
            part = _compared(vectors.where(F.col("list").isin(lists)), mine, k, digits, "_lists")
            out = part if out is None else out.unionByName(part)
    return out if out is not None else asked.sparkSession.createDataFrame([], "query_id long, vec_id long, distance double")


def stuffed_prompt(found: DataFrame, texts: DataFrame, question: Column) -> DataFrame:
    """M7: (query_id, prompt): the found rows' texts (vec_id, text) in rank order, then the question."""
    joined = found.join(texts, "vec_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    context = F.array_join(F.transform("x", lambda x: x["text"]), "\n\n")
    return joined.select("query_id", F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question).alias("prompt"))
