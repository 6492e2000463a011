"""Every registered query of the reference's operators against its SQL in DuckDB."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from loomline.plans import catalogue, projects, small  # noqa: E402, F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(rows):
    return sorted([tuple(round(x, 9) if isinstance(x, float) and math.isfinite(x) else x for x in r) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    assert got
    if name in catalogue.ORACLE:
        want = duck.sql(catalogue.ORACLE[name])
        assert sorted(want.columns) == columns
        assert got == norm(want.select(*(f'"{c}"' for c in columns)).fetchall())
