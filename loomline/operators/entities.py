"""Folding, de-duplicating, upserting and relating records. Input order is a column, never Spark's row order."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from loomline.sources.tables import stored


def fold(rows: DataFrame, key: list[str], order: str, is_defined: Column, *carried: str) -> DataFrame:
    """Per key def_cnt, decl_cnt and the first definition and declaration as structs of ``carried``.

    One aggregation with partial sums, where two halves and a full join would shuffle twice.
    """
    record = F.struct(*carried)
    pick = lambda which: F.min_by(F.when(which, record), F.when(which, F.col(order)))
    defined = F.coalesce(is_defined, F.lit(False))
    return rows.groupBy(*key).agg(
        F.count_if(defined).alias("def_cnt"),
        F.count_if(~defined).alias("decl_cnt"),
        pick(defined).alias("definition"),
        pick(~defined).alias("declaration"),
    )


def fold_first(rows: DataFrame, key: list[str], order: str, *carried: str) -> DataFrame:
    """A4: the first row of a key is its definition, later ones are counted."""
    return rows.groupBy(*key).agg(F.count("*").alias("def_cnt"), F.min_by(F.struct(*carried), F.col(order)).alias("definition"))


def unique_definition(functions: bool = True) -> Column:
    """A5: whether a folded entity is emitted."""
    single = F.col("def_cnt") == 1
    return single & (F.col("decl_cnt") <= 1) if functions else single


def review_status() -> Column:
    """The first of these that holds."""
    return F.when(F.col("def_cnt") == 0, "undefined").when(F.col("def_cnt") > 1, "multi_defined").when(F.col("decl_cnt") > 1, "multi_declared").otherwise("ok")


def first_text(definition: Column, declaration: Column) -> Column:
    """The definition's text, or else the declaration's, or else null."""
    return F.coalesce(F.nullif(definition, F.lit("")), F.nullif(declaration, F.lit("")))


def first_of(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    record = F.struct(*(c for c in rows.columns))
    return rows.groupBy(*key).agg(F.min_by(record, F.struct(*order)).alias("_row")).select("_row.*")


def latest(rows: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The upsert's outcome: the last row of each key."""
    record = F.struct(*(c for c in rows.columns))
    return rows.groupBy(*key).agg(F.max_by(record, F.struct(*order)).alias("_row")).select("_row.*")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def zip_back(requests: DataFrame, responses: DataFrame, index: str) -> DataFrame:
    """Every request with its response, '' where there is none."""
    return requests.join(responses, index, "left").withColumn("response", F.coalesce("response", F.lit("")))


#: Children that a task nests, about; a key's own children stay together.
_NESTED = 250_000


def attach(parents: DataFrame, children: DataFrame, key: str, record: Column, order: str) -> DataFrame:
    """Parents with their children as an ordered array; parents that only children name are made.

    children are counted first, so that more of them are more tasks, not larger ones.
    """
    tasks = max(children.sparkSession.sparkContext.defaultParallelism, children.count() // _NESTED + 1)
    nested = children.repartition(tasks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), record.alias("item")))).alias("_items"))
    out = parents.join(nested, key, "full_outer")
    return out.withColumn("children", F.transform(F.coalesce("_items", F.array()), lambda x: x["item"])).drop("_items")


def overloads(rows: DataFrame, key: list[str], signature: str) -> DataFrame:
    """(key, overload_count, is_overloaded) by distinct signatures."""
    counted = rows.groupBy(*key).agg(F.countDistinct(signature).alias("overload_count"))
    return counted.withColumn("is_overloaded", F.col("overload_count") > 1)


def siblings(rows: DataFrame, key: list[str], order: list[str], level: str, levels: int | None, name: str) -> DataFrame:
    """Prev and next: the nearest row before and after whose level is at most the row's own.

    So the next one climbs: the last child of a parent is followed by the parent's own next sibling. Rows of level
    ``levels`` and above count for no row and get null; with None all levels count. A level that is null or below 0 gives
    null; a row whose name is null counts for no other.

    Rows are range-sorted, and a stack of the levels that still count goes over them in one pass each way, whatever the
    depth; what is open at the end of a partition is handed on, so a key may be spread over many.
    """
    return _nearest(_nearest(rows, key, order, level, levels, name, "prev", False), key, order, level, levels, name, "next", True)


def _nearest(rows: DataFrame, key: list[str], order: list[str], level: str, levels: int | None, name: str, out: str, after: bool) -> DataFrame:
    spark, columns = rows.sparkSession, rows.columns
    by = [*(F.col(k).asc_nulls_first() for k in key), *((F.col(o).desc_nulls_last() if after else F.col(o).asc_nulls_first()) for o in order)]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema[name].dataType
    # beside each row: whether it looks further back than its partition; and, once a partition, its first key and what its last key leaves
    extra = StructType([StructField(out, kind), StructField("_open", BooleanType()), StructField("_part", LongType()), StructField("_mark", IntegerType()), StructField("_levels", ArrayType(LongType())), StructField("_names", ArrayType(kind))])
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema] + list(extra))
    at_level, at_name, at_key = columns.index(level), columns.index(name), [columns.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, single = TaskContext.get().partitionId(), None, None, True
        held: list[int] = []  # levels, ascending: each is nearer than those before it
        names: list = []
        kinds = to_arrow_schema(schema)
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(i).to_pylist() for i in at_key), strict=True)) if at_key else [()] * b.num_rows
            found, open_ = [], []
            for k, own, label in zip(keys, b.column(at_level).to_pylist(), b.column(at_name).to_pylist(), strict=True):
                if k != now or first is None:
                    if first is None:
                        first = (k,)
                    single = k == first[0]
                    now, held, names = k, [], []
                counts = own is not None and (levels is None or own < levels)
                i = bisect_right(held, own) if counts and own >= 0 else 0
                found.append(names[i - 1] if i else None)
                open_.append(counts and own >= 0 and not i and single)
                if counts and label is not None:
                    i = bisect_left(held, own)
                    del held[i:], names[i:]
                    held.append(own)
                    names.append(label)
            size = b.num_rows
            more = [pa.array(found, kinds.field(out).type), pa.array(open_), pa.array([part] * size, pa.int64()), pa.nulls(size, pa.int32()), pa.nulls(size, kinds.field("_levels").type), pa.nulls(size, kinds.field("_names").type)]
            yield pa.RecordBatch.from_arrays([*(c.cast(kinds.field(i).type) for i, c in enumerate(b.columns)), *more], schema=kinds)
        if first is not None:
            marks = [dict(zip(key, first[0], strict=True)) | {"_part": part, "_mark": 1}, dict(zip(key, now, strict=True)) | {"_part": part, "_mark": 2, "_open": single, "_levels": held, "_names": names}]
            yield pa.RecordBatch.from_pylist([{f: None for f in kinds.names} | m for m in marks], schema=kinds)

    done = stored(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(run, schema))
    marks = {(r["_part"], r["_mark"]): r for r in done.where("_mark IS NOT NULL").select("_part", "_mark", "_open", "_levels", "_names", *key).collect()}  # two a partition
    carried, carry = [], (None, [], [])
    for part in sorted({p for p, _ in marks}):
        head, tail = (tuple(marks[part, m][k] for k in key) for m in (1, 2))
        last = marks[part, 2]
        going = carry[0] is not None and carry[0] == (head,)
        if going and carry[1]:
            carried.append((part, carry[1], carry[2]))
        own = (list(last["_levels"]), list(last["_names"]))
        if last["_open"] and going:
            i = bisect_left(carry[1], own[0][0]) if own[0] else len(carry[1])
            own = (carry[1][:i] + own[0], carry[2][:i] + own[1])
        carry = ((tail,), *own)
    bring = spark.createDataFrame(carried, StructType([StructField("_part", LongType()), StructField("_before", ArrayType(LongType())), StructField("_named", ArrayType(kind))]))
    near = F.size(F.filter("_before", lambda x: x <= F.col(level)))
    out_of = F.when(F.col("_open") & F.col("_before").isNotNull() & (near > 0), F.element_at("_named", F.greatest(near, F.lit(1)))).otherwise(F.col(out))
    return done.where("_mark IS NULL").join(F.broadcast(bring), "_part", "left").select(*columns, out_of.alias(out))


def compare_runs(runs: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """The first run's keys with every run's value, '' where a run has none: (key, run_0, run_1, ...)."""
    out = runs[0].select(*key, F.coalesce(F.col(value), F.lit("")).alias("run_0"))
    for i, run in enumerate(runs[1:], 1):
        out = out.join(run.select(*key, F.col(value).alias(f"run_{i}")), key, "left").withColumn(f"run_{i}", F.coalesce(f"run_{i}", F.lit("")))
    return out
