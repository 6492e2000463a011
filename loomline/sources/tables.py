"""Tables in the shared folder: intermediate results that cut lineage, and keyed tables that take upserts.

``Table`` keeps rows in buckets by a hash of their key. An upsert writes the buckets it touches anew, under names of its own, and then
one small manifest that says which folder holds each bucket: the switch from one version to the next is the
appearance of the manifest's only file. A run that dies before leaves the old version as it was; readers of an
older version keep its folders until ``vacuum``. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; on a local master where it is unset, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/loomline/{uuid.uuid4().hex}"
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)
    return path


def stored(df: DataFrame) -> DataFrame:
    """df, written and read again: what is read twice is computed once, and lost executors cost nothing."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._loomline_path = path
    return out


def let_go(df: DataFrame) -> None:
    """Deletes a stored table of which nothing is read any more; what is not let go goes when the driver ends."""
    p, fs = _path(df.sparkSession, df._loomline_path)
    fs.delete(p, True)


class Table:
    """Rows with a unique key below ``path``; keys may be null. The number of buckets is fixed by the first version."""

    _MANIFEST = "version int, bucket int, folder string, n_rows long, buckets int, row_schema string"

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def _manifests(self) -> DataFrame:
        """All versions' manifests; no rows if there are none. Their files number one a version."""
        p, fs = _path(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return self.spark.createDataFrame([], self._MANIFEST)
        return self.spark.read.schema(self._MANIFEST).option("recursiveFileLookup", "true").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int | None) -> list:
        """A version's buckets, at most ``buckets`` rows."""
        all_ = self._manifests()
        if version is None:
            version = all_.agg(F.max("version")).first()[0] or 0
        return all_.where(F.col("version") == version).orderBy("bucket").collect()

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a version (None: the newest), of all or some of its buckets; None before the first."""
        found = self._folders(version)
        if not found:
            return None
        schema = StructType.fromDDL(found[0].row_schema)
        paths = [f"{self.path}/{r.folder}" for r in found if buckets is None or r.bucket in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows of the newest version with one of the keys; only the buckets that these fall in are read."""
        keys = stored(keys.select(*self.key).distinct())
        found = self._folders(None)
        if not found:
            return None
        touched = [r[0] for r in keys.select(self._bucket(found[0].buckets)).distinct().collect()]
        return self._matching(self.read(buckets=touched), keys, "left_semi")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _matching(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        """rows with (left_semi) or without (left_anti) one of the keys."""
        names = {k: f"_{k}_" for k in self.key}
        other = keys.select(*(F.col(k).alias(n) for k, n in names.items()))
        on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
        return rows.join(other, on, how)

    def upsert(self, rows: DataFrame, *order: str) -> int:
        """rows replace those with their keys, or are added; the new version's number.

        Of several rows with a key, and with ``order`` of these and the one that is there, the last by ``order`` stays; of equal
        ones the new one; else the greatest row.
        """
        old = self._folders(None)
        buckets = old[0].buckets if old else self.buckets
        schema = old[0].row_schema if old else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        columns = StructType.fromDDL(schema).names
        whole = F.struct(*(F.col(f"`{c}`") for c in columns))
        last = lambda df, by: df.groupBy(*self.key).agg(F.max_by(whole, by).alias("_row")).select("_row.*")
        new = stored(last(rows.select(*columns), F.struct(*order, *(c for c in columns if c not in order))))
        touched = [r[0] for r in new.select(self._bucket(buckets)).distinct().collect()]
        if not touched:
            return old[0].version if old else 0
        before = self.read(buckets=touched) if old else None
        if before is None:
            merged = new
        elif order:
            both = before.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
            merged = last(both, F.struct(*order, "_new"))
        else:
            merged = self._matching(before, new, "left_anti").unionByName(new)
        folder, name = f"data/{uuid.uuid4().hex}", "_bucket_of_key"
        merged.withColumn(name, self._bucket(buckets)).repartition(min(len(touched), buckets), name).write.partitionBy(name).parquet(f"{self.path}/{folder}")
        counts = self.spark.read.schema(f"{schema}, {name} int").option("basePath", f"{self.path}/{folder}").parquet(f"{self.path}/{folder}").groupBy(name).agg(F.count("*").alias("n")).collect()
        version = (old[0].version if old else 0) + 1
        kept = [(version, r.bucket, r.folder, r.n_rows, buckets, schema) for r in old if r.bucket not in touched]
        self._commit(version, kept + [(version, r[0], f"{folder}/{name}={r[0]}", r.n, buckets, schema) for r in counts])
        return version

    def _commit(self, version: int, manifest: list[tuple]) -> None:
        """One file, moved to its place when it is whole."""
        self.spark.createDataFrame(manifest, self._MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/{version:010d}-{uuid.uuid4().hex}")

    def vacuum(self, keep: int = 1) -> int:
        """Deletes folders that none of the newest ``keep`` versions names, left behind by dead runs or older versions; their number."""
        newest = self.version()
        named = {r.folder for r in self._manifests().where(F.col("version") > newest - keep).select("folder").distinct().collect()}
        p, fs = _path(self.spark, f"{self.path}/data")
        gone = []
        for run in fs.listStatus(p) if fs.exists(p) else []:
            run = run.getPath()
            parts = [x.getPath() for x in fs.listStatus(run) if x.isDirectory()]
            dead = [x for x in parts if f"data/{run.getName()}/{x.getName()}" not in named]
            gone += [run] if len(dead) == len(parts) else dead
        for x in gone:
            fs.delete(x, True)
        return len(gone)
