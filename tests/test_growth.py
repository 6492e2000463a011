"""What must not grow faster than the input: keys that many rows share, expressions written out again, batches."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.batches import PART, small
from loomline.operators import instructions, records


def test_parents_are_looked_up_within_their_file(spark):
    """Each file's elements meet its own parents only; those without a parent are not gathered under one null key."""
    rows = [(f, i, p, line, line + 1, line, line + 1) for f in ("a", "b") for i, p, line in (("C", None, 1), ("m", "C", 2), ("n", "C", 4))]
    found = spark.createDataFrame(rows, "location string, id string, parent_id string, line int, end_line int, start int, stop int")
    out = records.previous_end(found)
    assert sorted((r.location, r.id, r.prev_end_line) for r in out.collect()) == sorted((f, *x) for f in ("a", "b") for x in (("C", None), ("m", 1), ("n", 3)))


def test_documentation_is_cleaned_once(spark):
    docs = spark.createDataFrame([("1", "Do", "int a;", "/** x */"), ("2", "Do", "int b;", "/** */")], "id string, instruction string, code string, docstring string")
    out = instructions.documentation_pairs(docs)
    once = docs.select(T.clean_docstring(F.col("docstring")).alias("output"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace")
    assert plan(out) == plan(once)
    assert [(r.id, r.output) for r in out.collect()] == [("1", "x")]


def test_extract_elements_builds_what_it_returns(spark):
    from loomline.plans import catalogue

    df = catalogue.QUERIES["extract_elements"](spark, "/root/testdata/sf0.001")
    made = next(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "MapInArrow" in x)
    assert "signature" in made and "rich" not in made and "macro_args" not in made


def test_batches_are_read_in_small_parts():
    """All rows, in order, and no part larger than it may be."""
    assert sum(b.num_rows for b in small([pa.record_batch({"x": ["a" * 3000] * 5001})])) == 5001
    seen = []

    def parts(batches):
        for b in batches:
            seen.append(b.nbytes)
            yield b

    whole = pa.record_batch({"id": list(range(64)), "text": ["x" * (1 << 19)] * 64})
    assert [x for b in parts(small([whole])) for x in b.column(0).to_pylist()] == list(range(64)) and max(seen) <= PART


def test_responses_are_split_once(spark):
    """Not once more for each of their lines."""
    docs = spark.createDataFrame([(1, "x\n@brief a\n b\nb \n\nc\n@return z"), (2, None), (3, "")], "id int, text string")
    out = docs.select("id", T.clean_response(F.col("text")).alias("y"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted((r.id, r.y) for r in out.collect()) == [(1, "@brief a\n b\nc\n@return"), (2, None), (3, "")]


def test_parameters_are_read_only_if_asked_for(spark, monkeypatch):
    """Names, places and return types are the same without them."""
    from loomline.operators import cpp, extract

    code = "#if A\nint f(int a)\n#else\nint f(char b)\n#endif\n{ return 0; }\nstruct S { S(int x = 1); ~S(); auto g(int) -> long; static int n; };\nvoid S::h(const char *p) const {}\nexplicit(true) operator bool();\n"
    whole = extract.scan(code, "a.h")[0]
    read = []
    parameter = cpp.Scanner.parameter
    monkeypatch.setattr(cpp.Scanner, "parameter", lambda self, head, a, b: read.append(head.text(a, b)) or parameter(self, head, a, b))
    bare = extract.scan(code, "a.h", signatures=False)[0]
    assert read == ["int a", "char b"]  # two heads of one body are told apart by them
    cut = lambda rows: [({k: v for k, v in e.items() if k not in ("signature", "rich")}, (e.get("signature") or {}).get("return_type")) for e in rows]
    assert cut(bare) == cut(whole) and sum(e["name"] == "f" for e in bare) == 2
    files = spark.createDataFrame([("a.h", code)], "location string, code string")
    out = extract.elements(files, repeated=False, columns=("name", "signature.return_type"))
    assert out.schema["signature"].dataType.names == ["return_type"]
    assert [(r.name, r.signature and r.signature.return_type) for r in out.collect()] == [(e["name"], e.get("signature") and e["signature"]["return_type"]) for e in whole]


def test_more_children_are_more_tasks(spark, monkeypatch):
    """A task nests about so many; classes are read once for their own pairs and their methods'."""
    from loomline.operators import entities

    monkeypatch.setattr(entities, "_NESTED", 10)
    items = spark.range(1000).select((F.col("id") % 50).alias("k"), "id")
    out = entities.attach(items.select("k").distinct(), items, "k", F.struct(F.col("id").cast("string").alias("name"), F.lit("c").alias("code")), "id")
    assert "hashpartitioning(k" in out._jdf.queryExecution().toString() and ", 101)" in out._jdf.queryExecution().toString()
    assert sum(len(r.children) for r in out.collect()) == 1000
    classes = out.select(F.col("k").cast("string").alias("name"), F.lit("d").alias("declaration"), F.col("children").alias("methods"))
    pairs = instructions.nested_pairs(classes)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("Range") == classes._jdf.queryExecution().optimizedPlan().toString().count("Range")
    assert pairs.count() == 1050 and pairs.where("ord = 0 AND output = 'd'").count() == 50
    bare = spark.createDataFrame([("A", None, None), ("B", "b", [])], "name string, declaration string, methods array<struct<name:string,code:string>>")
    assert sorted((r.name, r.ord, r.output) for r in instructions.nested_pairs(bare).collect()) == [("A", 0, ""), ("B", 0, "b")]


def test_records_are_made_where_a_file_is_scanned(spark):
    """nothing is shuffled or stored on the way to records; of elements at one place the first in the text comes first."""
    code = "// licence\nint a;\n// of m\nint m, n;\n/** of C */\nclass C { // no\n  // of f\n  void f(); };\nvoid C::f() {}\n"
    out = records.records(spark.createDataFrame([("a.h", code), ("b.h", code)], "location string, code string"), repeated=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "parquet" not in plan.lower()
    got = [(r.name, r.line, r.prev_end_line, r.comments, r.docstrings, r.context_before[-1:]) for r in out.where("location = 'b.h'").collect()]
    assert got == [
        ("a", 2, None, [], [], ["// licence"]), ("m", 4, 2, ["// of m"], [], ["// of m"]), ("n", 4, 4, [], [], ["// of m"]),
        ("C", 6, 4, [], ["/** of C */"], ["/** of C */"]), ("f", 8, 6, ["  // of f"], [], ["// of f"]), ("f", 9, 8, [], [], ["void f(); };"]),
    ]


def test_pairs_leave_where_their_record_is(spark):
    """long code is cut beside its record: nothing is shuffled or stored; code that nothing splits has no pieces."""
    calls = "".join(f"  call{i}(a, b);\n" for i in range(200))
    names = ", ".join(f"E{i}" for i in range(600))
    files = spark.createDataFrame([("f.cpp", f"int zero;\n// of f\nvoid f(int a) {{\n{calls}}}\nenum L {{ {names} }};\nenum M {{ A }};\n")], "location string, code string")
    out = records.code_pairs(records.documented(records.records(files, repeated=False, columns=records.PAIRS)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "parquet" not in plan.lower()
    got = out.orderBy("id", "idx").collect()
    whole, parts = [r for r in got if r["mode"] == "whole"], [r for r in got if r["mode"] != "whole"]
    assert sorted(r.output for r in whole) == ["enum M{A};", "int zero;"] and all(r.idx == 0 for r in whole)
    assert [r["mode"] for r in parts] == ["first", *["next"] * (len(parts) - 2), "last"] and [r.idx for r in parts] == list(range(len(parts)))
    assert all('using comments: "of f"' in r.input for r in parts) and all(any(f"call{i}(a, b);" in r.output for r in parts) for i in range(200))
