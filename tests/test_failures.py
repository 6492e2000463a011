"""A file that can't be read must not look like one that holds nothing."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomline.operators import extract, records
from loomline.plans import catalogue, projects

SF = "/root/testdata/sf0.001"


def poisoned(make):
    """The files that make gives, with code as bytes, which the scanner fails on, and readable ones beside it."""
    return lambda spark, sf_dir: make(spark, sf_dir).select("location", F.encode("code", "utf-8").alias("code"))


def test_strict_runs_end_at_a_failure(spark):
    """Which file it was is said; without strict the others go on, as before."""
    df = spark.createDataFrame([(f"f{i}.cpp", f"int g{i}();") for i in range(3)], "location string, code string")
    skip = lambda place: 1 // int(place[1]) < 0  # noqa: E731 - fails on f0.cpp alone
    with pytest.raises(PySparkException, match="f0.cpp: not read: ZeroDivisionError"):
        extract.elements(df, skip=skip, strict=True).collect()
    assert sorted(r.name for r in extract.elements(df, skip=skip).collect()) == ["g1", "g2"]
    files = spark.createDataFrame([("b.h", bytearray(b"int a;"))], "location string, code binary")
    with pytest.raises(PySparkException, match="b.h: not read: "):
        records.records(files).collect()
    assert records.records(files, strict=False).collect() == []


def test_want_of_memory_is_raised(monkeypatch):
    """It is the worker's, not the file's: read again elsewhere the file has its elements."""

    def full(*_):
        raise MemoryError

    monkeypatch.setattr(extract, "Scanner", full)
    with pytest.raises(MemoryError):
        extract.scan("int a;", "a.h")


def test_doc_pairs_end_at_a_failure(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_synthetic_files", poisoned(catalogue._synthetic_files))
    with pytest.raises(PySparkException, match="src/[0-9]+.cpp: not read: "):
        catalogue.QUERIES["doc_pairs"](spark, SF).collect()


def test_element_records_end_at_a_failure(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "_synthetic_files", poisoned(catalogue._synthetic_files))
    with pytest.raises(PySparkException, match="src/[0-9]+.cpp: not read: "):
        catalogue.QUERIES["element_records"](spark, SF).collect()


def test_using_directives_end_at_a_failure(spark, monkeypatch):
    monkeypatch.setattr(projects, "_named_files", poisoned(projects._named_files))
    with pytest.raises(PySparkException, match="[lu]/[0-9]+.(h|cpp): not read: "):
        catalogue.QUERIES["using_directives"](spark, SF).collect()


def test_documents_without_text_have_their_files(spark, tmp_path):
    """As in the SQL, which reads no text."""
    spark.createDataFrame([(1, "some */ text"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["using_directives"](spark, str(tmp_path)).collect())
    assert got == [(f"u/{n}.cpp", 2, f"lib{n}", f"lib{n}", f"l/{n}.h") for n in (1, 2, 3)]
    owned = catalogue.QUERIES["resolved_names"](spark, str(tmp_path)).groupBy("location").count().collect()
    assert sorted(map(tuple, owned)) == [(f"u/{n}.cpp", 8) for n in (1, 2, 3)]
