"""Profiles, splits, batches and fixed-length sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, by: str, known: list[str] | None = None) -> DataFrame:
    """(by, n); values in known that don't occur count 0."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"))
    if known is None:
        return out
    dim = rows.sparkSession.createDataFrame([(k,) for k in known], f"`{by}` string")
    return dim.join(out, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def unhandled(rows: DataFrame, kind: str, expected: tuple[str, ...]) -> DataFrame:
    """(bucket, kind, n): how often each kind occurs, those in expected apart from the others. Null kinds are unexpected."""
    bucket = F.when(F.col(kind).isin(*expected), "expected").otherwise("unexpected")
    return rows.groupBy(bucket.alias("bucket"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def flagged(rows: DataFrame, *flags: str) -> DataFrame:
    """One row: n, and for each flag how many rows have it set."""
    return rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(f)).alias(f) for f in flags))


def extremes(rows: DataFrame, by: list[str], length: str, what: Column, order: str) -> DataFrame:
    """Least and greatest length and what has it; of equal ones the first."""
    low, high = F.struct(F.col(length), F.col(order)), F.struct(F.col(length), -F.col(order))
    return rows.groupBy(*by).agg(F.min(length).alias("min_len"), F.min_by(what, low).alias("min_at"), F.max(length).alias("max_len"), F.max_by(what, high).alias("max_at"), F.count("*").alias("n"))


def last_lengths(rows: DataFrame, key: list[str], order: str, text: str, length: str) -> DataFrame:
    """Per key the last record's length and lines."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(F.col(length).alias("length"), F.size(F.split(F.col(text), "\n", -1)).alias("n_lines")), F.col(order)).alias("x")).select(*key, "x.length", "x.n_lines")


def histogram(rows: DataFrame, by: str, value: str, bins: int = 50) -> DataFrame:
    """(by, bin, n): equal widths between least and greatest value, the last bin closed.

    A group of one value has it in the first bin; a null group is a group; null values count nowhere. Values are counted first: the
    ranges, one row per group, are joined to each distinct value of a group, not to each row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    span = counted.groupBy(F.col(by).alias("_by")).agg(F.min("_value").alias("lo"), F.max("_value").alias("hi"))
    width = F.col("hi") - F.col("lo")
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("_value") - F.col("lo")) * bins / F.nullif(width, F.lit(0))), F.lit(bins - 1)))
    placed = counted.join(span, F.col(by).eqNullSafe(F.col("_by"))).select(by, at.cast("long").alias("bin"), "_n")
    return placed.groupBy(by, "bin").agg(F.sum("_n").alias("n"))


def split_exactly(rows: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Rows with ``split``: floor(share x rows) are "test", by a hash of the key.

    Hash prefixes are counted (4096 rows), a running sum over them ranks buckets, and ranks within buckets make the
    exact number without one task that sees all rows.
    """
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key)))
    hashed = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    all_before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = sizes.select("_b", F.coalesce(F.sum("_n").over(all_before), F.lit(0)).alias("_first"), F.sum("_n").over(everything).alias("_all"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    out = ranked.join(F.broadcast(first), "_b")  # 4096 rows
    test = F.col("_first") + F.col("_r") <= F.floor(F.col("_all") * share)
    return out.withColumn("split", F.when(test, "test").otherwise("train")).drop("_h", "_b", "_n", "_r", "_first", "_all")


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """rows with ``rank`` from 0 within each group in the order given (the first column of it a number), without a task per group.

    Ranges of the first order column (its exponent and three binary digits: some thousand at most) are counted, a
    running sum over the counts gives where each range begins, and rows are ranked within (group, range). Infinities and
    NaN are ranges of their own; NaN comes last, as in Spark's order.
    """
    x = F.abs(F.col(order[0]).cast("double"))
    x = F.when(F.isnan(x), None).otherwise(x)
    finite = F.when(x < float("inf"), x)
    exponent = F.when(finite == 0, F.lit(-2000.0)).otherwise(F.floor(F.log2(finite)))
    coarse = (exponent * 8 + F.when(finite == 0, 0).otherwise(F.floor((finite / F.pow(F.lit(2.0), exponent) - 1) * 8))).cast("int")
    sign = F.when(F.col(order[0]) < 0, -1).otherwise(1)
    odd = F.when(F.col(order[0]).isNull(), -1_000_000).when(F.isnan(F.col(order[0]).cast("double")), 900_000).when(x == float("inf"), sign * 800_000)
    dealt = rows.withColumn("_range", F.coalesce(odd, sign * (coarse + 20_000)))
    sizes = dealt.groupBy(by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select(F.col(by).alias("_by"), F.col("_range").alias("_of"), F.coalesce(before, F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order)) - 1
    out = dealt.withColumn("_nth", nth).join(first, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_of")))
    return out.withColumn("rank", F.col("_first") + F.col("_nth")).select(*rows.columns, "rank")


def batches(rows: DataFrame, by: str, order: list[str], size: int | Column) -> DataFrame:
    """Rows with ``batch``: size rows of a group each, in order."""
    return ranked(rows, by, order).withColumn("batch", F.floor(F.col("rank") / size).cast("long")).drop("rank")


def padded(ids: Column, length: int, pad: int) -> Column:
    """P23."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad).cast("long"), length)), 1, length)


def truncated(ids: Column, length: int = 512) -> Column:
    """P22."""
    return F.size(ids) > length


def joined_sequence(prompt: Column, answer: Column, end: int) -> Column:
    """P24."""
    return F.concat(prompt, answer, F.array(F.lit(end).cast("long")))


def rates(rows: DataFrame, tokens: str, seconds: str) -> DataFrame:
    """Totals and tokens a second."""
    return rows.agg(F.sum(tokens).alias("tokens"), F.sum(seconds).alias("seconds"), (F.sum(tokens) / F.nullif(F.sum(seconds), F.lit(0))).alias("tokens_per_second"))
