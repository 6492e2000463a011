"""Sources and sinks: code trees, JSON lines, reports, grouped and ordered writers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomline.functions import keys

SOURCE = ("cpp", "cc", "cxx", "c")
HEADER = ("h", "hpp", "hh", "hxx")


@F.pandas_udf(StringType())
def _without_invalid(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE, stop: list[str] | None = None, strict: bool = False, errors: str = "replace") -> DataFrame:
    """(location, code) of the files below root with one of the extensions.

    What happens to bytes that are not UTF-8: with "replace" they become U+FFFD, with "ignore" they go, with "strict" the
    file's code is null; ``strict`` is short for that. The extension is pushed to the listing.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{%s}" % ",".join(extensions)).load(root)
    base = root if ":" in root else f"file:{root}"
    path = keys.relative_path(F.regexp_replace("path", "^file:/+", "file:/"), base)
    text = F.col("content").cast("string")
    policies = {"replace": F.make_valid_utf8(text), "strict": F.try_validate_utf8(text), "ignore": F.when(F.is_valid_utf8(text), text).otherwise(_without_invalid("content"))}
    if errors not in policies:
        raise ValueError(f"errors is one of {', '.join(policies)}, not {errors}")
    code = policies["strict" if strict else errors]
    out = files.select(path.alias("location"), code.alias("code"))
    return out.where(~keys.stopped(F.col("location"), stop)) if stop else out


def python_corpus(spark: SparkSession, root: str, skip_setup: bool = True) -> DataFrame:
    """S6, S6b."""
    out = tree(spark, root, ("py",))
    return out.where(~F.contains(F.substring_index("location", "/", -1), F.lit("setup"))) if skip_setup else out


def include_dirs(files: DataFrame, named_only: bool = False) -> DataFrame:
    """The distinct folders that hold headers; named_only: only those called include or inc."""
    folder = F.regexp_extract("location", r"^(.*)/[^/]*$", 1)
    out = files.where(F.col("location").rlike(r"\.(%s)$" % "|".join(HEADER))).select(folder.alias("dir")).distinct()
    return (out.where(F.substring_index("dir", "/", -1).isin("include", "inc")) if named_only else out).orderBy("dir")


def json_lines(spark: SparkSession, path: str, schema: str, tolerate: bool = True) -> DataFrame:
    """With tolerate bad lines are kept as ``_corrupt_record``, else they raise."""
    reader = spark.read.option("mode", "PERMISSIVE" if tolerate else "FAILFAST")
    return reader.schema(schema + (", _corrupt_record string" if tolerate else "")).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S9."""
    return spark.read.option("multiLine", "true").schema(schema).json(path)


def truth(c: Column) -> Column:
    """Booleans that older files hold as the strings "True" and "False"."""
    return F.lower(c.cast("string")) == "true"


def decoded(c: Column) -> Column:
    """Bytes as UTF-16 if they carry its mark, else as UTF-8 if valid, else as Latin-1."""
    marked = F.substring(F.hex(c), 1, 4).isin("FFFE", "FEFF")
    return F.when(marked, F.decode(c, "UTF-16")).when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))


def installed_models(names: DataFrame) -> DataFrame:
    """Owner and id from cache folder names ``models--owner--id``."""
    parts = F.split("name", "--")
    return names.where((F.size(parts) == 3) & (parts[0] == "models")).select(parts[1].alias("owner"), parts[2].alias("model"))


def write_by_type(rows: DataFrame, path: str, by: str = "type") -> None:
    """K1, K6: JSON lines in one folder per type, committed as a whole."""
    rows.write.partitionBy(by).json(path)  # a type with very many rows stays spread over its tasks


def write_pairs(code: list[DataFrame], docs: list[DataFrame], path: str, ordinal: str | None = None) -> None:
    """Code pairs and documentation pairs, each the union of its parts in the order given.

    With ``ordinal`` rows have the number of their part in a column of that name, so that the order does not hang on the files' names.
    """
    for name, parts in (("code", code), ("docs", docs)):
        out = None
        for nth, p in enumerate(parts):
            p = p if ordinal is None else p.withColumn(ordinal, F.lit(nth))
            out = p if out is None else out.unionByName(p, allowMissingColumns=True)
        if out is not None:  # a union's partitions, and so its files, come in the order of its parts
            out.write.json(f"{path}/{name}")


def write_records(rows: DataFrame, path: str, content: tuple[str, ...] = ("code", "docstring", "text")) -> None:
    """K3: records that have some content, as JSON lines."""
    have = [c for c in content if c in rows.columns]
    rows.where(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in have)).isNotNull()).write.json(path)


def write_text(rows: DataFrame, line: Column, path: str) -> None:
    """K4, K5: reports and diffs."""
    rows.select(line.alias("value")).write.text(path)


def save_index(vectors: DataFrame, path: str) -> None:
    """K7, M6."""
    vectors.select("vec_id", "embedding").write.parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("vec_id long, embedding array<float>").parquet(path)
