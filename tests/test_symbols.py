"""Names across files, and small operators that had no test of their own."""

import math

from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import extract, lines, profile, symbols


def owners(spark, **files):
    rows = [(k.replace("__", "."), v) for k, v in files.items()]
    found = extract.elements(spark.createDataFrame(rows, "location string, code string"))
    return {(r.location, r.line, r["name"]): (r.qualified, r.symbol.location if r.symbol else None) for r in symbols.owned(found).collect()}


def test_the_innermost_scope_wins(spark):
    got = owners(
        spark,
        a__h="struct S { void f(); };\nnamespace n { struct S { void f(); }; namespace m { struct R { void f(); }; } }\nnamespace other { struct Q { void f(); }; }",
        b__cpp="void S::f() {}\nnamespace n {\nvoid S::f() {}\nvoid m::R::f() {}\nvoid ::S::f() {}\nnamespace k { void S::f() {} }\n}\nvoid n::m::R::f() {}\nvoid Q::f() {}\n",
        c__cpp="namespace n {\nusing namespace other;\nvoid Q::f() {}\n}\nvoid Q::f() {}\nusing other::Q;\nvoid Q::f() {}\ntemplate <class A> void S<std::map<int, A>>::f() {}\n",
    )
    assert got == {
        ("b.cpp", 1, "f"): ("S", "a.h"), ("b.cpp", 3, "f"): ("n::S", "a.h"), ("b.cpp", 4, "f"): ("n::m::R", "a.h"), ("b.cpp", 5, "f"): ("S", "a.h"), ("b.cpp", 6, "f"): ("n::S", "a.h"), ("b.cpp", 8, "f"): ("n::m::R", "a.h"),
        ("b.cpp", 9, "f"): (None, None), ("c.cpp", 3, "f"): ("other::Q", "a.h"), ("c.cpp", 5, "f"): (None, None), ("c.cpp", 7, "f"): ("other::Q", "a.h"), ("c.cpp", 8, "f"): ("S", "a.h"),
    }


def test_aliases_and_nearer_directives(spark):
    got = owners(spark, a__h="namespace x { struct P { void f(); }; }\nnamespace y { struct P { void f(); }; }\n", b__cpp="namespace z = x;\nvoid z::P::f() {}\nnamespace w {\nnamespace z = y;\nvoid z::P::f() {}\n}\nvoid v::P::f() {}\nnamespace v = y;\n")
    assert got == {("b.cpp", 2, "f"): ("x::P", "a.h"), ("b.cpp", 5, "f"): ("y::P", "a.h"), ("b.cpp", 7, "f"): (None, None)}


def test_no_files(spark):
    empty = spark.createDataFrame([], "location string, code string")
    assert symbols.owned(extract.elements(empty)).count() == 0 and symbols.directives(extract.elements(empty)).count() == 0


def test_histogram_of_odd_groups(spark):
    rows = [("a", 0.0), ("a", 10.0), ("a", 5.0), (None, 1.0), (None, 3.0), ("one", 7.0), ("one", 7.0), ("a", None), ("gone", None)]
    got = {(r.k, r.bin): r.n for r in profile.histogram(spark.createDataFrame(rows, "k string, v double"), "k", "v", 4).collect()}
    assert got == {("a", 0): 1, ("a", 2): 1, ("a", 3): 1, (None, 0): 1, (None, 3): 1, ("one", 0): 2}


def test_ranks_of_odd_numbers(spark):
    values = [math.nan, math.inf, -math.inf, 0.0, -1.5, 1e300, None, math.nan, 5e-324, -math.inf]
    df = spark.createDataFrame([("g", v, i) for i, v in enumerate(values)], "k string, v double, i long")
    order = [r.i for r in df.orderBy("v", "i").collect()]
    got = sorted((r["rank"], r.i) for r in profile.ranked(df, "k", ["v", "i"]).collect())
    assert got == list(enumerate(order))
    assert {r.batch for r in profile.batches(df, "k", ["v", "i"], 4).collect()} == {0, 1, 2}


def test_positions_and_blank_runs(spark):
    row = spark.createDataFrame([("ab\n\n\n\n\tc\n",)], "t string")
    assert row.select(T.normalize_indent(F.col("t"))).first()[0] == "ab\n\n    c"
    assert row.select(T.normalize_indent(F.col("t"), most_feeds=1)).first()[0] == "ab\n    c"
    at = lines.offsets(row.withColumn("k", F.lit(1)), "k", text="t").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("line_no", "start", "length"))).alias("x"))
    place = lambda line, col: lines.position_to_offset(F.transform("x", lambda s: s["start"]), F.transform("x", lambda s: s["length"]), F.lit(line), F.lit(col))
    got = at.select(*(place(*p) for p in ((1, 1), (1, 3), (1, 99), (5, 2), (99, 1), (0, 0)))).first()
    assert tuple(got) == (0, 2, 2, 7, 9, 0)


def test_comments_that_are_kept(spark):
    df = spark.createDataFrame([("f", "// TODO: x\n// plain\nint a; // behind\n/* b */")], "location string, text string")
    got = lines.comments(df, "location", keep=T.is_noteworthy(F.col("text"))).collect()
    assert [r.text for r in got] == [r.text for r in lines.comments(df, "location").where(T.is_noteworthy(F.col("text"))).collect()]
    assert {r.line_no for r in lines.comments(df, "location", keep=F.col("type") == "line").collect()} == {1, 2}
