"""Rules of single operators on small inputs of our own."""

import json
import random

from pyspark.sql import functions as F

from loomline.functions import keys
from loomline.functions import text as T
from loomline.operators import diffs, entities, extract, fragments, instructions, lines, profile, retrieval
from loomline.sources import files, model
from loomline.streaming import ingest

CODE = """#include "a.h"
#define MAX(a, b) ((a) > (b) ? (a) : (b))
namespace outer { namespace {
/** Doc of Box. */
template <class T, int N = 2> class Box : public Base<T> {
 public:
  Box(int a = 3, const char *s = "{;") noexcept;
  virtual ~Box();
  virtual int size() const = 0;
  static Box make();
  int field;
};
template <> class Box<int, 1> {};
union U { int i; float f[2]; };
enum class Color : unsigned char { Red, Green };
typedef void (*Callback)(int);
using Bytes = std::vector<char>;
static const int limit = 7; // }
}}
using namespace std;
int outer::Box::size() const { if (x) { return f([&](int q) { return q; }); } try { g(); } catch (...) { } return 0; }
Box::operator bool() const { return true; }
"""


def scanned():
    return extract.Scanner(CODE, "src/a.cpp").found


def test_scanner_kinds_and_parents():
    found = [(e["type"], e["name"], e["parent_name"]) for e in scanned()]
    for want in [
        ("inclusion_directive", "a.h", None),
        ("macro_definition", "MAX", None),
        ("namespace", "outer", None),
        ("namespace", None, "outer"),
        ("class_template", "Box", None),
        ("constructor", "Box", "Box"),
        ("destructor", "Box", "Box"),
        ("cxx_method", "size", "Box"),
        ("cxx_method", "make", "Box"),
        ("class_template_partial_specialization", "Box", None),
        ("union_decl", "U", None),
        ("enum_decl", "Color", None),
        ("typedef_decl", "Callback", None),
        ("type_alias_decl", "Bytes", None),
        ("var_decl", "limit", None),
        ("using_directive", None, None),
        ("lambda_expr", None, "size"),
        ("cxx_try_stmt", None, "size"),
        ("cxx_catch_stmt", None, "size"),
        ("conversion_function", "operator bool", "Box"),
    ]:
        assert want in found, (want, found)
    assert ("var_decl", "field", "Box") not in found


def test_scanner_signatures():
    by = {(e["type"], e["is_defined"]): e for e in scanned() if e.get("signature")}
    box = by["constructor", False]["signature"]
    assert box["parameters"] == [{"name": "a", "type": "int", "default_value": "3"}, {"name": "s", "type": "const char *", "default_value": '"{;"'}]
    assert box["qualifiers"]["is_noexcept"] and not box["qualifiers"]["is_const"]
    size = next(e for e in scanned() if e["name"] == "size" and not e["is_defined"])["signature"]
    assert size["qualifiers"]["is_pure_virtual"] and size["qualifiers"]["is_virtual"] and size["qualifiers"]["is_const"] and size["return_type"] == "int"
    box = next(e for e in scanned() if e["type"] == "class_template")
    assert [p["name"] for p in box["template_parameters"]] == ["T", "N"] and box["template_parameters"][1]["default_value"] == "2"
    assert box["code"].endswith("};") and box["line"] == 5 and box["end_line"] == 12
    color = next(e for e in scanned() if e["type"] == "enum_decl")
    assert color["is_scoped"] and color["underlying_type"] == "unsigned char"
    assert extract.body_of('int f() { g("}"); /* } */ } x') == '{ g("}"); /* } */ }'


def test_elements_table(spark):
    df = spark.createDataFrame([("src/a.cpp", CODE), ("src/b.cpp", None), ("src/c.cpp", "int broken( {"), ("src/a.cpp", CODE)], "location string, code string")
    out = extract.elements(df).cache()
    assert out.count() == out.select("id").distinct().count()
    ids = {r.id for r in out.collect()}
    assert all(r.parent_id in ids for r in out.where("parent_id is not null").collect())
    assert extract.find_element(out, "cxx_method", "size", True).first().end_line == 21
    assert extract.elements(df.limit(0)).count() == 0


def test_fragment_invariants():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("ab \n;,") for _ in range(rng.randrange(0, 400)))
        target = rng.randrange(1, 90)
        plain = fragments.split_plain(text, target)
        assert "".join(text[s:e] for s, e in plain) == text
        assert all(e - s <= target for s, e in plain)
        over = fragments.split_overlapping(text, target, rng.randrange(0, 30), [rng.randrange(0, 400) for _ in range(5)])
        starts = [s for s, _ in over]
        assert starts == sorted(set(starts))
        covered = set()
        for s, e in over:
            covered.update(range(s, e))
        assert covered == set(range(len(text)))
        assert all(len(c) <= 60 for c in fragments.split_recursive(text, 60, 10))
    assert fragments.split_points("a;{b;{c;}}'}'") == [2, 5, 9, 10]


def test_budget_is_monotone(spark):
    row = spark.range(1).select(F.lit("a b c").alias("i"), F.lit(" l l").alias("l"), F.lit(" x x x").alias("c"), F.lit(" y y y y").alias("m"))
    parts = {"instruction": F.col("i"), "location": F.col("l"), "context": F.col("c"), "comments": F.col("m"), "docstring": F.lit(None).cast("string")}
    got = {b: row.select(*instructions.within_budget(parts, b)).first() for b in (12, 11, 8, 7, 5, 4, 3, 2)}
    assert got[12] == ("a b c l l x x x y y y y", False)
    assert got[11][0] == got[8][0] == "a b c l l x x x"
    assert got[7][0] == got[5][0] == "a b c l l"
    assert got[4] == ("a b c", False) and got[2] == ("a b c", True)


def test_text_edges(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.clean_response(F.lit("no tags\n\nno tags"))) == "no tags"
    assert one(T.strip_reasoning(F.lit("plain"))) == "plain"
    assert one(T.docstring_blocks(F.lit("nothing"))) == ""
    assert one(T.split_declaration(F.lit("int f();"))) == ("int f();", None)
    assert one(T.clean_cpp_code(F.lit(None).cast("string"))) is None
    assert one(T.is_noteworthy(F.lit("// =========="))) is False
    assert one(F.array_join(lines.preceding_comments(F.array(*map(F.lit, ("x;", "// a", "", "/* b */", "int y;"))), F.lit(5)), "|")) == "// a|/* b */"
    split = F.array(*map(F.lit, ("abc", "def", "ghi")))
    assert one(lines.code_slice(split, F.lit(1), F.lit(2), F.lit(3), F.lit(3))) == "bc\ndef\ngh"
    assert one(lines.code_slice(split, F.lit(2), F.lit(2), F.lit(2), F.lit(3), overshoot=True)) == "ef"
    assert one(keys.stopped_by_suffix(F.lit("a/test.cpp"), ["*test.cpp", "b"])) is True
    assert one(keys.layer_number(F.lit("model.layers.12.w"))) == 12
    assert one(instructions.simple_prompt(F.lit("lambda"), F.lit("x"))) is None
    assert one(instructions.answer_budget(F.lit(10000), F.lit(2000))) == 4000
    assert "Code:\nint f();\nUse this" in one(instructions.docstring_prompt(F.lit("int f();")))


def test_entities_and_profile(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "y"), (3, "b", "z")], "ord long, k string, v string")
    assert {r.k: r.ord for r in entities.latest(rows, ["k"], "ord").collect()} == {"a": 2, "b": 3}
    assert entities.pending(rows, rows.where("k = 'a'"), "k").count() == 1
    asked = spark.createDataFrame([(1, "p"), (2, None)], "id long, prompt string")
    out = model.answered(asked, lambda: lambda ps: [p.upper() for p in ps])
    assert {r.id: r.response for r in entities.zip_back(asked, out, "id").collect()} == {1: "P", 2: ""}
    split = profile.split_exactly(spark.range(1003).withColumnRenamed("id", "k"), "k")
    assert split.where("split = 'test'").count() == 100
    assert profile.rates(spark.createDataFrame([(10, 2.0), (20, 3.0)], "t long, s double"), "t", "s").first()[2] == 6.0
    vectors = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in retrieval.nearest(vectors, vectors.where("vec_id = 0"), 1).collect()] == [1]
    made = spark.range(1).select(diffs.insertion_diff(F.lit("f.cpp"), F.array(F.lit("a"), F.lit("b")), F.lit(2), F.lit("/** x */"))).first()[0]
    assert made.endswith("@@ -1,2 +1,3 @@\n a\n+/** x */\n b\n")


def test_comments_before(spark):
    text = "// licence\nint a;\n// of b\nint b;"
    df = spark.createDataFrame([("f", text)], "location string, text string")
    found = lines.comments(df, "location")
    elements = spark.createDataFrame([("f", "a", 2, None), ("f", "b", 4, 2)], "location string, name string, line int, prev_end_line int")
    assert [(r.name, r.text) for r in lines.comments_before(elements, found).collect()] == [("b", "// of b")]


def test_files_and_stream(spark, tmp_path):
    src = tmp_path / "src"
    (src / "inc").mkdir(parents=True)
    (src / "a.cpp").write_text("int f() { return 1; }\n")
    (src / "inc" / "a.h").write_bytes(b"int g(); \xff")
    (src / "setup.py").write_text("x")
    (src / "b.py").write_text("y")
    got = {r.location: r.code for r in files.tree(spark, str(src), files.SOURCE + files.HEADER).collect()}
    assert set(got) == {"a.cpp", "inc/a.h"} and got["inc/a.h"].endswith("�")
    assert [r.location for r in files.python_corpus(spark, str(src)).collect()] == ["b.py"]
    assert [r.dir for r in files.include_dirs(files.tree(spark, str(src), files.HEADER)).collect()] == ["inc"]
    (tmp_path / "x.jsonl").write_text('{"type": "a", "is_defined": "False"}\nbad\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "type string, is_defined string")
    assert rows.where("_corrupt_record is null").select(files.truth(F.col("is_defined"))).first()[0] is False and rows.count() == 2
    files.write_by_type(spark.createDataFrame([("a", "é"), ("b", "y")], "type string, code string"), str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out" / "type=a").glob("*.json")).read_text()) == {"code": "é"}
    q = ingest.stream_elements(spark, str(src), str(tmp_path / "el"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert [r.name for r in spark.read.parquet(str(tmp_path / "el")).collect()] == ["f"]
    utf16 = spark.createDataFrame([(bytearray("hé".encode("utf-16")),), (bytearray(b"h\xe9"),), (bytearray("hé".encode()),)], "b binary")
    assert {r[0] for r in utf16.select(files.decoded(F.col("b"))).collect()} == {"hé"}


def test_more_queries_than_one_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i * i % 31), float(i)]) for i in range(40)], "vec_id long, embedding array<float>")
    want = sorted(retrieval.nearest(rows, rows, 3).collect())
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    assert sorted(retrieval.nearest(rows, rows, 3).collect()) == want and len(want) == 120
