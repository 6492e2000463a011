"""Operators that no registered query runs, on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import keys
from loomline.functions import text as T
from loomline.operators import entities, extract, fragments, instructions, lines, profile, records
from loomline.sources import files, model


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def names(code):
    return [(e["type"], e["name"], e["parent_type"], e["parent_name"]) for e in extract.Scanner(code, "a.cpp").found]


OUTSIDE = """struct S { void f(); };
void S::f() {}
template <class T> class B { void g(); template <class U> void h(U u); };
template <class T> void B<T>::g() {}
template <class T> template <class U> void B<T>::h(U u) {}
namespace n { class K { K(); }; }
n::K::K() {}
auto z(int a) -> int { return a; }
int one, *two = nullptr, three[3];
std::map<int, int> m, k;
"""


def test_owners_declarators_and_trailing_types():
    found = names(OUTSIDE)
    assert found.count(("cxx_method", "f", "struct_decl", "S")) == 2
    assert found.count(("cxx_method", "g", "class_template", "B")) == 2
    assert found.count(("function_template", "h", "class_template", "B")) == 2
    assert found.count(("constructor", "K", "class_decl", "K")) == 2
    assert ("function_decl", "z", "translation_unit", None) in found
    assert [x[1] for x in found if x[0] == "var_decl"] == ["one", "two", "three", "m", "k"]
    z = next(e for e in extract.Scanner(OUTSIDE, "a.cpp").found if e["name"] == "z")
    assert z["signature"]["return_type"] == "int"


def test_owner_in_another_file(spark):
    df = spark.createDataFrame([("a.h", "namespace n { struct S { void f(); }; }"), ("b.cpp", "void n::S::f() {}\nvoid Gone::g() {}")], "location string, code string")
    out = extract.resolved(extract.elements(df))
    rows = {(r.location, r.name): r for r in out.collect()}
    assert rows["b.cpp", "f"].parent_id == rows["a.h", "S"].id and rows["b.cpp", "f"].parent_type == "struct_decl"
    assert rows["b.cpp", "g"].parent_id is None and rows["b.cpp", "g"].owner == "Gone"
    # declaration and definition have one key now
    key = keys.function_key(F.col("parent_type"), F.col("parent_name"), F.col("name"), F.lit(False), F.array().cast("array<string>"))
    assert out.where("name = 'f'").select(key).distinct().count() == 1


def test_many_brackets_take_no_time():
    code = "void f() " + "{" * 3000 + "}" * 3000 + "\n" + "#define A 1\n" * 3000
    assert len(names(code)) == 3001


def test_project_paths_and_lookup(spark):
    rows = spark.createDataFrame([("/usr/include/x.h",), ("/work/p/a.h",), ("a.h",), ("/opt/y.h",), ("/usr/local/include/z.h",)], "location string")
    assert [r[0] for r in rows.where(extract.in_project(F.col("location"), "/work/p")).collect()] == ["/work/p/a.h", "a.h"]
    assert one(spark, extract.qualified_path(F.array(F.lit("n"), F.lit("C")))) == "n::C"
    code = spark.createDataFrame([("a.h", "int a;\nint b;\n")], "location string, code string")
    places = spark.createDataFrame([("a.h", 1, 5, 2, 6), ("none", 1, 1, 1, 2)], "location string, line int, col int, end_line int, end_col int")
    assert {r.location: r.code for r in extract.code_at(code, places).collect()} == {"a.h": "a;\nint b", "none": None}
    macro = next(e for e in extract.Scanner("#define MAX(a, b) ((a) > (b))\n#define ONE 1\n", "m.h").found if e["name"] == "MAX")
    assert macro["macro_args"] == ["a", "b"] and macro["code"] is None
    assert one(spark, lines.whole_lines(F.array(*map(F.lit, "abc")), F.lit(2), F.lit(3))) == "b\nc"


def test_keys(spark):
    p = F.array(F.struct(F.lit("int").alias("type"), F.lit("a").alias("name"), F.lit("3").alias("default_value")), F.struct(F.lit("char").alias("type"), F.lit("b").alias("name"), F.lit(None).cast("string").alias("default_value")))
    assert one(spark, keys.verbose_key(F.lit("cxx_method"), F.lit("void"), F.lit("f"), p)) == "cxx_method void f(int a 3, char b)"
    assert [one(spark, keys.stopped(F.lit("a/test/b.cpp"), x)) for x in (["test"], ["none"], [])] == [True, False, False]
    kinds = ("cxx_method", "struct_decl", "var_decl", "namespace")
    assert [one(spark, keys.family(F.lit(k))) for k in kinds] == ["functions", "classes", "declarations", None]
    assert [one(spark, keys.is_method(F.lit(k))) for k in ("constructor", "function_decl")] == [True, False]
    messages = one(spark, instructions.chat_messages(("user", F.lit("q")), ("assistant", F.lit("a"))))
    assert [tuple(m) for m in messages] == [("user", "q"), ("assistant", "a")]


def test_prompts_of_all_kinds(spark):
    for kind in instructions.PROMPTS:
        got = one(spark, instructions.simple_prompt(F.lit(kind), F.lit("x"), F.lit("C")))
        assert (got is None) == (kind in instructions.SKIPPED)
        if got is not None:
            assert got == instructions.PROMPTS[kind].format(name="x", class_name="C")


def test_split_by_kind_and_points(spark):
    code = "void f() { a(); b(); }\nvoid g() { c(); }\nint tail;\n" * 4
    spans = fragments.split_by_kind(code, 70, "cxx_method")
    points = fragments.split_points(code)
    assert spans[0][1] in points and spans == fragments.split_overlapping(code, 70, points=points)
    assert fragments.split_by_kind(code, 70, "var_decl") == fragments.split_plain(code, 70)
    with pytest.raises(ValueError):
        fragments.split_by_kind(code, 70, "enum_decl")
    rows = spark.createDataFrame([(1, "class_decl", code, 70), (2, "var_decl", code, 70), (3, "var_decl", None, 70)], "id long, type string, code string, target int")
    got = fragments.fragments(rows, "id", "code", fragments.split_by_kind, "target", "type").orderBy("id", "idx").collect()
    assert [(r.start, r.end) for r in got if r.id == 1] == spans and {r.id for r in got} == {1, 2}


def test_chunks(spark):
    text = "\n\n".join(" ".join(f"word{i}" for i in range(k)) for k in (3, 40, 1, 90))
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    got = fragments.chunks(rows, "id", "text", 100, 20).orderBy("idx").collect()
    assert {r.id for r in got} == {1} and all(0 < len(r.chunk) <= 100 and r.chunk in text for r in got)
    assert set(" ".join(r.chunk for r in got).split()) == set(text.split())


def test_emitted_and_methods(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "c " * 600)], "id long, code string")
    pieces = spark.createDataFrame([(2, 0, "x"), (2, 1, "y"), (2, 2, "z")], "id long, idx int, code string")
    got = instructions.emitted(rows, pieces).orderBy("id", "idx").collect()
    assert [(r.id, r.mode, r.output) for r in got] == [(1, "whole", "a b"), (2, "first", "x"), (2, "next", "y"), (2, "last", "z")]
    nested = spark.createDataFrame([("C", [("m", "code")])], "name string, methods array<struct<name:string,code:string>>")
    direct = spark.createDataFrame([("D", "n", "more", 7)], "class_name string, name string, code string, line int")
    assert sorted(tuple(r) for r in instructions.all_methods(direct, nested).collect()) == [("C", "m", "code", None), ("D", "n", "more", 7)]
    docs = spark.createDataFrame([(1, "Write documentation for f", "int f();", "/** about f */"), (2, "Write", "x", None)], "id long, instruction string, code string, docstring string")
    assert [tuple(r) for r in instructions.documentation_pairs(docs).collect()] == [(1, "Write documentation for f with code: int f();", "about f")]


def test_writers_and_readers(spark, tmp_path):
    code = spark.createDataFrame([("i1", "o1")], "input string, output string")
    more = spark.createDataFrame([("i2", "o2")], "input string, output string")
    docs = spark.createDataFrame([("d", "t")], "input string, output string")
    files.write_pairs([code, more], [docs], str(tmp_path / "pairs"))
    read = [json.loads(x) for p in sorted((tmp_path / "pairs" / "code").glob("part*")) for x in p.read_text().splitlines()]
    assert [x["input"] for x in read] == ["i1", "i2"]
    assert spark.read.json(str(tmp_path / "pairs" / "docs")).count() == 1
    rows = spark.createDataFrame([("a", "x", None), ("b", "", None), ("c", None, "doc")], "name string, code string, docstring string")
    files.write_records(rows, str(tmp_path / "records"))
    assert {r.name for r in spark.read.json(str(tmp_path / "records")).collect()} == {"a", "c"}
    files.write_text(rows, F.concat(F.lit("> "), F.col("name")), str(tmp_path / "text"))
    assert {r.value for r in spark.read.text(str(tmp_path / "text")).collect()} == {"> a", "> b", "> c"}
    vectors = spark.createDataFrame([(1, [0.5, 2.0])], "vec_id long, embedding array<float>")
    files.save_index(vectors, str(tmp_path / "index"))
    assert files.load_index(spark, str(tmp_path / "index")).collect() == vectors.collect()
    (tmp_path / "a.json").write_text('[{"x": 1},\n {"x": 2}]')
    assert sorted(r.x for r in files.json_array(spark, str(tmp_path / "a.json"), "x long").collect()) == [1, 2]
    caches = spark.createDataFrame([("models--own--m",), ("datasets--own--m",), ("models--own",)], "name string")
    assert [tuple(r) for r in files.installed_models(caches).collect()] == [("own", "m")]


def test_tree_options(spark, tmp_path):
    for d in ("src/include", "src/inc", "src/other", "src/test"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "a.h").write_text("int x;")
    (tmp_path / "src" / "test" / "bad.cpp").write_bytes(b"\xff")
    (tmp_path / "src" / "setup.py").write_text("x")
    root = str(tmp_path / "src")
    headers = files.tree(spark, root, files.HEADER, stop=["test"])
    assert {r.location for r in headers.collect()} == {"include/a.h", "inc/a.h", "other/a.h"}
    assert [r.dir for r in files.include_dirs(headers, named_only=True).collect()] == ["inc", "include"]
    assert [r.code for r in files.tree(spark, root, strict=True).collect()] == [None]
    assert [r.location for r in files.python_corpus(spark, root, skip_setup=False).collect()] == ["setup.py"]


def test_model_seam_counts_failures(spark):
    def client():
        def ask(prompts):
            if any("bad" in p for p in prompts):
                raise RuntimeError
            return [p[::-1] for p in prompts]

        return ask

    asked = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None)], "id long, prompt string").coalesce(1)
    got = {r.id: (r.response, r.failed) for r in model.answered(asked, client, batch=1).collect()}
    assert got == {1: ("ba", False), 2: ("", True), 3: ("", False)}
    counted = model.token_counter(spark.createDataFrame([(1, "a b"), (2, None)], "id long, text string"), lambda: lambda xs: [len(x.split()) for x in xs])
    assert {r.id: r.tokens for r in counted.collect()} == {1: 2, 2: 0}


def test_ranked_like_a_window(spark):
    rows = [(k, v) for k in "ab" for v in (0, -3, 7, 7, 1 << 40, -(1 << 40), None, 5, 6, 1000, 1001)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "id long, k string, v long")
    got = {r.id: r["rank"] for r in profile.ranked(df, "k", ["v", "id"]).collect()}
    for k in "ab":
        ids = sorted((i for i, x in enumerate(rows) if x[0] == k), key=lambda i: (rows[i][1] is not None, rows[i][1] or 0, i))
        assert [got[i] for i in ids] == list(range(len(ids)))
    batches = profile.batches(df, "k", ["v", "id"], 4).groupBy("k", "batch").count().collect()
    assert sorted(r["count"] for r in batches) == [3, 3, 4, 4, 4, 4]


def test_records_first_element_takes_no_licence(spark):
    code = "// licence\nint a;\n/// of b\n// and more\nint b;\nclass C {\n  // of m\n  void m();\n};\n"
    out = records.records(spark.createDataFrame([("f.cpp", code), ("empty.cpp", ""), ("null.cpp", None)], "location string, code string"))
    got = {r.name: (r.comments, r.docstrings, r.context_before, r.context_after) for r in out.collect()}
    assert got["a"] == ([], [], ["// licence"], ["int a;", "/// of b", "// and more"])
    assert got["b"][:2] == (["// and more"], ["/// of b"])
    assert got["m"][0] == ["  // of m"] and got["C"][:2] == ([], [])


def test_long_code_becomes_fragments(spark):
    body = "".join(f"  call{i}(a, b);\n" for i in range(200))
    found = records.documented(records.records(spark.createDataFrame([("f.cpp", f"int zero;\n/** Does much. */\nvoid f(int a) {{\n{body}}}\n")], "location string, code string")))
    got = records.code_pairs(found).where("input like '%C++ function f%'").orderBy("idx").collect()
    assert [r.mode for r in got][0] == "first" and [r.mode for r in got][-1] == "last" and len(got) > 2
    assert all('using docstring: "Does much."' in r.input for r in got) and "line:3" in got[0].input and "line:" not in got[1].input
    assert [r.output for r in records.doc_pairs(found).collect()] == ["Does much."]


def test_line_ends_and_siblings(spark):
    assert one(spark, T.normalize_indent(F.lit("\n\ta  \n\n\n\n b\n"))) == "    a\n\n b"
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (4, 0)], "id long, level int").withColumn("k", F.lit(1))
    got = {r.id: (r.prev, r.next) for r in entities.siblings(rows, ["k"], ["id"], "level", 2, "id").collect()}
    assert got == {1: (None, 4), 2: (1, 3), 3: (2, 4), 4: (1, None)}


def test_decoding_policies(spark, tmp_path):
    (tmp_path / "a.cpp").write_bytes("x�\xff".encode() + b"\xff y")
    got = {e: files.tree(spark, str(tmp_path), errors=e).first()["code"] for e in ("replace", "strict", "ignore")}
    assert got == {"replace": "x�\xff� y", "strict": None, "ignore": "x�\xff y"}


def test_diagnostics(spark):
    df = spark.createDataFrame([("a", "int f( {\n/* never"), ("b", "#warning old\n// #error no\n#error bad\n"), ("c", 'auto s = "}"; // )\n'), ("d", None), ("e", "/*/")], "location string, code string")
    got = sorted(tuple(r) for r in extract.diagnostics(df).collect())
    assert got == [
        ("a", 1, 6, "Error", "'(' is not closed"),
        ("a", 1, 8, "Error", "'{' is not closed"),
        ("a", 2, 1, "Fatal", "comment is not closed"),
        ("b", 1, 1, "Warning", "old"),
        ("b", 3, 1, "Error", "bad"),
        ("e", 1, 1, "Fatal", "comment is not closed"),
    ]
    assert {r.severity for r in extract.diagnostics(df, errors_only=True).collect()} == {"Error", "Fatal"}


def test_body_without_regard_to_comments():
    code = "f() { /* } */ }"
    assert extract.body_of(code) == "{ /* } */ }" and extract.body_of(code, aware=False) == "{ /* }"


def test_siblings_of_any_level(spark):
    levels = [0, 1, 2, 5, 7, 5, 1, None, 0]
    rows = spark.createDataFrame([(1, i, lev) for i, lev in enumerate(levels)], "k int, i int, lev int")
    got = {r.i: (r.prev, r.next) for r in entities.siblings(rows, ["k"], ["i"], "lev", None, "i").collect()}

    def near(i, step):
        j = i + step
        while 0 <= j < len(levels) and (levels[j] is None or levels[j] > levels[i]):
            j += step
        return j if 0 <= j < len(levels) else None

    assert got == {i: (None, None) if lev is None else (near(i, -1), near(i, 1)) for i, lev in enumerate(levels)}
    assert entities.siblings(rows.limit(0), ["k"], ["i"], "lev", None, "i").count() == 0


def test_find_method(spark):
    kind = "id int, name string, methods array<struct<name:string,code:string>>"
    df = spark.createDataFrame([(1, "C", [("a", "1")]), (2, "C", [("m", "2"), ("m", "3")]), (3, "D", [("m", "4")]), (4, "E", None)], kind)
    assert [tuple(r) for r in instructions.find_method(df, "C", "m").collect()] == [(2, "m", "2")]
    assert instructions.find_method(df, "E", "m").count() == 0


def test_doxygen_forms(spark):
    got = one(spark, extract.doxygen(F.lit("/** Adds. Twice over!\n * @param[in] a first\n * @param b second one\n * @code\n * f(1);\n * @endcode\n * @code g(); @endcode\n */")))
    assert (got.brief, got.details, got.deprecated, got.code_blocks) == ("Adds.", "Twice over!", None, ["f(1);", "g();"])
    assert [tuple(p) for p in got.params] == [("a", "first", "[in]"), ("b", "second one", "")]
    bare = one(spark, extract.doxygen(F.lit("/// only words")))
    assert (bare.brief, bare.details, bare.params) == ("only words", None, [])
    assert one(spark, extract.doxygen(F.lit(""))).brief is None


def test_unhandled_kinds(spark):
    df = spark.createDataFrame([("a", True), ("a", None), ("b", False), (None, True)], "k string, f boolean")
    assert {tuple(r) for r in profile.unhandled(df, "k", ("a",)).collect()} == {("expected", "a", 2), ("unexpected", "b", 1), ("unexpected", None, 1)}
    assert tuple(profile.flagged(df, "f").first()) == (4, 2)
