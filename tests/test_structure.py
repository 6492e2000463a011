"""Includes, siblings of any depth and comments before elements, against brute force."""

import random

from loomline.operators import entities, extract, includes, lines


def test_include_places_and_cycles(spark):
    rows = [
        ("src/a.cpp", '#include "b.h"\n#include <lib/c.h>\n#include "lib/c.h"\n#include <b.h>\n#include MACRO\n'),
        ("src/b.h", '#include "../inc/lib/c.h"\n#include "b.h"\n'), ("inc/b.h", "int inc_b;"), ("inc/lib/c.h", '#include "d.h"\n'), ("inc/lib/d.h", '#include "c.h"\n'),
        ("other/lib/c.h", "int far;"), ("x.cpp", "/* #include \"a\" */\n#if 0\n#include <lib/d.h>\n#endif\n"),
    ]
    files = spark.createDataFrame(rows, "location string, code string")
    edges = includes.edges(extract.elements(files), files, ["inc", "other/"])
    got = {(r.location, r.line): r.target for r in edges.collect()}
    assert got == {
        ("src/a.cpp", 1): "src/b.h", ("src/a.cpp", 2): "inc/lib/c.h", ("src/a.cpp", 3): "inc/lib/c.h", ("src/a.cpp", 4): "inc/b.h", ("src/a.cpp", 5): None,
        ("src/b.h", 1): "inc/lib/c.h", ("src/b.h", 2): "src/b.h", ("inc/lib/c.h", 1): "inc/lib/d.h", ("inc/lib/d.h", 1): "inc/lib/c.h", ("x.cpp", 3): "inc/lib/d.h",
    }
    reach = {(r.source, r.header): r.depth for r in includes.closure(edges).collect()}
    assert reach["src/a.cpp", "inc/lib/d.h"] == 2 and reach["src/b.h", "src/b.h"] == 1 and reach["inc/lib/c.h", "inc/lib/c.h"] == 2
    assert {h for s, h in reach if s == "src/a.cpp"} == {"src/b.h", "inc/lib/c.h", "inc/b.h", "inc/lib/d.h"}
    one = includes.closure(edges, spark.createDataFrame([("x.cpp",)], "location string"))
    assert {(r.header, r.depth) for r in one.collect()} == {("inc/lib/d.h", 1), ("inc/lib/c.h", 2)}
    assert includes.closure(edges.where("false")).count() == 0


def test_paths(spark):
    from pyspark.sql import functions as F

    paths = {"a/../b": "b", "./a//b/.": "a/b", "../../a": "../../a", "/a/../../b": "/../b", "a/b/../../c": "c", "": ""}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", includes.normal_path(F.col("p")).alias("q")).collect()
    assert {r.p: r.q for r in rows} == paths


def nearest(rows, i, step, levels):
    level = rows[i][2]
    if level is None or level < 0 or (levels is not None and level >= levels):
        return None
    j = i + step
    while 0 <= j < len(rows) and rows[j][0] == rows[i][0]:
        other = rows[j][2]
        if other is not None and other <= level and rows[j][3] is not None:
            return rows[j][3]
        j += step
    return None


def test_siblings_are_the_nearest(spark):
    r = random.Random(6)
    for levels, deep in ((None, 3), (4, 6), (None, 3000)):
        rows = [(k, i, r.choice([None, -1, *range(deep)][: deep + 2]) if deep < 10 else r.randrange(deep), None if r.random() < 0.05 else f"{k}{i}", "x") for k, n in (("a", 700), ("b", 3), ("c", 1), (None, 60)) for i in range(n)]
        df = spark.createDataFrame(rows, "k string, i long, level int, name string, prev_ string").repartition(5)
        got = {(x.k, x.i): (x.prev, x.next) for x in entities.siblings(df, ["k"], ["i"], "level", levels, "name").collect()}
        assert got == {(x[0], x[1]): (nearest(rows, n, -1, levels), nearest(rows, n, 1, levels)) for n, x in enumerate(rows)}
    chain = spark.range(20_000).selectExpr("0 as k", "id as i", "cast(id as int) as level", "cast(id as string) as name")
    out = {x.i: (x.prev, x.next) for x in entities.siblings(chain, ["k"], ["i"], "level", None, "name").collect()}
    assert out[0] == (None, None) and out[19_999] == ("19998", None)  # each level deeper than all before
    assert entities.siblings(chain.limit(0), ["k"], ["i"], "level", None, "name").count() == 0


def test_comments_before_any_element(spark):
    r = random.Random(7)
    elements = [(i, r.choice("ab"), (e := r.choice([None, r.randrange(900)])), (e or 0) + r.randrange(-5, 300)) for i in range(200)]
    found = [(r.choice("ab"), r.randrange(1000), i) for i in range(300)]
    e = spark.createDataFrame(elements, "id long, location string, prev_end_line int, line int")
    c = spark.createDataFrame(found, "location string, line_no int, comment long")
    out = lines.comments_before(e, c)
    want = {(i, x) for i, f, a, b in elements for g, at, x in found if a is not None and f == g and a <= at < b}
    assert {(r.id, r.comment) for r in out.collect()} == want and out.count() == len(want)
    assert out.columns == ["location", "id", "prev_end_line", "line", "comment_line", "comment"]
    for plan in (lines.comments(e.selectExpr("location", "'x' as text"), "location"), lines.offsets(e.selectExpr("location", "'x' as text"), "location")):
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_long_documents_are_read_in_linear_time(spark):
    df = spark.range(1).selectExpr("id", "repeat('// a comment\n/* b\n*/\n', 200000) as text")
    assert lines.comments(df, "id").count() == 400_000
    assert lines.offsets(df, "id").agg({"start": "max"}).first()[0] == 200_000 * 21


def test_a_closure_reads_no_pair_table_again(spark, monkeypatch):
    """A round's table has a row for each file, not for each pair; files are scanned once; roots, chains and cycles as before."""
    n = 12
    edges = spark.createDataFrame([(f"f{i}", 1, "x", f"f{i + 1}") for i in range(n)] + [(f"f{n}", 1, "x", f"f{n - 1}")], "location string, line int, name string, target string")
    rows, stored = [], includes.stored

    def counted(df):
        out = stored(df)
        if "header" in out.columns or "levels" in out.columns:
            rows.append(out.count())
        return out

    monkeypatch.setattr(includes, "stored", counted)
    reach = {(r.source, r.header): r.depth for r in includes.closure(edges).collect()}
    want = {(f"f{i}", f"f{j}"): j - i for i in range(n + 1) for j in range(i + 1, n + 1)} | {(f"f{n}", f"f{n - 1}"): 1, (f"f{n}", f"f{n}"): 2, (f"f{n - 1}", f"f{n - 1}"): 2}
    assert reach == want
    assert rows and max(rows) <= n + 1
    some = includes.closure(edges, spark.createDataFrame([("f9",), ("f11",), ("none",)], "location string"))
    assert {(r.source, r.header): r.depth for r in some.collect()} == {k: v for k, v in want.items() if k[0] in ("f9", "f11")}
