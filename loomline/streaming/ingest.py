"""Incremental runs of the batch operators over arriving files, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.functions.keys import relative_path
from loomline.operators.extract import elements


def stream_elements(spark: SparkSession, root: str, out: str, checkpoint: str, extensions: str = "cpp,cc,cxx,c") -> StreamingQuery:
    """Elements of files as they arrive below root, each file once; the checkpoint is the resume state.

    Locations, and so ids, are those that ``files.tree`` gives. out gets a folder for each batch: read as a table it has one more column, ``batch``."""
    files = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % extensions).load(root)
    place = relative_path(F.regexp_replace("_metadata.file_path", "^file:/+", "file:/"), root if ":" in root else f"file:{root}")
    named = files.select(place.alias("location"), F.col("value").alias("code"))

    def write(batch: DataFrame, number: int) -> None:
        elements(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")  # a batch that is tried again replaces itself

    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
