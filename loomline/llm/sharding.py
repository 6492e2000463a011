"""Sharding by vector bin packing of bytes, tokens and rows.

Documents with equal texts are a group. Each group, largest first, goes to the shard where the dot product of its
vector (bytes, tokens, rows, each as a share of a shard) with the shard's residual capacity is highest. Groups
above a quarter of a shard are split by a hash of doc_id into parts of about that size. The groups that weigh
more than 1/``HEAVY`` of a shard, of which there are at most shards x HEAVY in each dimension, are placed first on
the driver; what they leave of each shard is dealt evenly to parts of the other groups, and each part is packed in a task
of its own against its share, so that no task or driver sees all groups.

The law kept is ``bytes``: shards' sizes are nearly equal. Tokens here are words between ASCII white space.

Heavy groups are placed by all three dimensions alike: there are few of them, and what they leave uneven in bytes the
light ones make up. These are placed with weights 1, 0.01 and 0.001: bytes keep the law, tokens and rows decide among
shards that are near equal in bytes.

Defined results: null text counts as empty: 16 bytes, no tokens; very long texts are measured whole, one of more than a
quarter of a shard stays in one piece; repeated rows are rows of one group; ties go to the smaller shard; slots follow
buckets of a hash of doc_id, then doc_id; a null doc_id stays null; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.common import WORD, lean, stored, text_or_empty

SHARDS, HEAVY = 40, 200
#: Parts of groups packed in one task, and rows numbered in one task, about.
_UNITS, _ROWS = 50_000, 50_000
#: Weights of bytes, tokens and rows for heavy and for light groups.
_JOINT, _BYTES = np.array([1.0, 1.0, 1.0]), np.array([1.0, 0.01, 0.001])


def place(sizes: np.ndarray, capacity: np.ndarray, weight: np.ndarray = _BYTES) -> np.ndarray:
    """The shard of each unit; sizes (units x 3) in descending order, capacity (shards x 3) is what is left, changed in place."""
    scale = np.maximum(capacity.sum(0) / len(capacity), 1e-9)
    left = capacity / scale * weight
    units = sizes / scale
    out = np.empty(len(sizes), np.int64)
    for i, u in enumerate(units):
        k = out[i] = int((left @ u).argmax())
        left[k] -= u * weight
    np.subtract.at(capacity, out, sizes)
    return out


def measured(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    size = (F.octet_length(text) + 16).cast("long")
    return docs.select("doc_id", size.alias("size"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group"))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    rows = stored(measured(docs))
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums, F.count("*").alias("n")).first()
    share = np.array([total["bytes"] or 0, total["tokens"] or 0, total["rows"] or 0], float) / shards
    over = lambda part: F.greatest(*(F.col(c) / float(max(s, 1e-9)) for c, s in zip(("bytes", "tokens", "rows"), share, strict=True))) * part
    groups = rows.groupBy("group").agg(*sums)
    # at most 4 x shards groups in each dimension are above a quarter of a shard
    split = groups.where(over(4) > 1).select("group", F.ceil(over(4)).cast("int").alias("parts")).collect()
    split = spark.createDataFrame([(bytes(r[0]), r[1]) for r in split], "group binary, parts int")
    rows = rows.join(F.broadcast(split), "group", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0)).cast("int")).drop("parts")
    units = stored(rows.groupBy("group", "part").agg(*sums).withColumn("weight", over(HEAVY)))
    heavy = units.where("weight > 1").orderBy(F.col("bytes").desc(), "group", "part").collect()  # at most 3 x shards x HEAVY, but for split groups
    capacity = np.tile(share, (shards, 1))
    sizes = np.array([[r["bytes"], r["tokens"], r["rows"]] for r in heavy], float).reshape(-1, 3)
    placed = [(bytes(r["group"]), r["part"], int(k)) for r, k in zip(heavy, place(sizes, capacity, _JOINT), strict=True)]
    placed = spark.createDataFrame(placed, "group binary, part int, shard int")
    light = units.where("weight <= 1")
    tasks = max(1, -(-light.count() // _UNITS))
    residual = capacity / tasks

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        table = pa.Table.from_batches(batches).cast(kind) if batches else None
        if table is None or not table.num_rows:
            return
        of = table.column("task").to_numpy()
        for k in np.unique(of):
            t = table.filter(pa.array(of == k))
            sizes = np.stack([t.column(c).to_numpy() for c in ("bytes", "tokens", "rows")], 1).astype(float)
            order = np.argsort(-sizes[:, 0], kind="stable")
            shard = np.empty(len(sizes), np.int64)
            shard[order] = place(sizes[order], residual.copy())
            yield pa.RecordBatch.from_arrays([t.column("group").combine_chunks(), t.column("part").combine_chunks(), pa.array(shard, pa.int32())], ["group", "part", "shard"])

    kind = pa.schema([("task", pa.int32()), ("group", pa.binary()), ("part", pa.int32()), ("bytes", pa.int64()), ("tokens", pa.int64()), ("rows", pa.int64())])
    dealt = light.select(F.pmod(F.xxhash64("group", "part"), F.lit(tasks)).cast("int").alias("task"), "group", "part", "bytes", "tokens", "rows")
    others = dealt.repartition(tasks, "task").sortWithinPartitions("task", "group", "part").mapInArrow(lean(packed), "group binary, part int, shard int")
    where = stored(others.unionByName(placed))
    buckets = max(1, (total["n"] or 0) // (shards * _ROWS))
    out = rows.join(where, ["group", "part"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")).select("doc_id", "size", "text_crc32", "shard", "bucket")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")) - 1
    return out.withColumn("nth", nth).join(first, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).cast("long").alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    return assign(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
