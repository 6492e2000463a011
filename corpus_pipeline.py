"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents; n_chars follows the text.

* ``language_id`` drops documents without a language: those whose text is null or has no letter, and those of which no
  language is as likely as all others together.
* ``near_dedup`` keeps, of each group of near copies (five-word shingles, similarity 0.8 or more), the one with
  the smallest doc_id; candidates come from SimHash fingerprints within 3 bits, and from bands of minima.
* ``suffix_dedup`` cuts passages of 50 bytes or more that an earlier document has.
* ``secret_scan`` masks secrets.
* ``best_fit_packing`` packs what is left into sequences of 2048 tokens.

Defined results: a null text, like an empty one, has no language and goes in the first stage; rows with a null doc_id
stay, match nothing and lose nothing as copies; of repeated rows of a doc_id all stay, since copies are told apart by doc_id;
very long texts are read whole by every stage; of equal documents the smallest doc_id stays; an empty table gives
no rows; other columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import bpe, language_id, packing, secret_scan, simhash, suffix_dedup
from loomline.llm.common import let_go, stored


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars brought in line with text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.deduplicated(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, bpe.default_path())


STAGES = [
    ("language_id", identify),
    ("near_dedup", near_dedup),
    ("suffix_dedup", passage_dedup),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

#: Hashed n-gram models, fingerprints and a genetic algorithm are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if last is not None:  # read for the last time
            let_go(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
