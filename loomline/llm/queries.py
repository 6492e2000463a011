"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import ann, bpe, chat_format, hamerly, language_id, merkle, packing, quality_rules, secret_scan, sharding, simhash, suffix_dedup, warc
from loomline.llm.common import table
from loomline.llm.oracle import ORACLE  # noqa: F401 - registered by the entry point

#: Conversation -1: control strings in both turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), bpe.default_path())


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), bpe.default_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turn = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), turn).select("conv_id", F.col("turn").cast("long"), "role", F.lit(CONTROL).alias("text"))
    return chat_format.digests(rows.unionByName(extra))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamerly.clustered(table(spark, sf_dir, "embeddings"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_bpe": op2_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_nearest": op8_nearest,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_warc": op11_warc,
    "op12_centroids": op12_centroids,
    "op13_merkle": op13_merkle,
}
