"""The C++ scanner: conditions, declarators, and files that can't harm others."""

import random
import time

from loomline.operators import extract


def rows(code):
    return [(e["type"], e["name"], e["condition"]) for e in extract.Scanner(code, "a.cpp").found if e["type"] != "preprocessing_directive"]


def declared(code):
    return [(e["type"], e["name"], e.get("var_type") or (e.get("signature") or {}).get("return_type"), e["parent_name"]) for e in extract.Scanner(code, "a.cpp").found]


def test_branches_that_share_a_brace():
    assert rows("#if A\nint u(){\n#else\nint v(){\n#endif\n}\nint w(){}") == [("function_decl", "u", "A"), ("function_decl", "v", "!(A)"), ("function_decl", "w", None)]
    found = extract.Scanner("#ifdef A\nclass X : P {\n#else\nclass X {\n#endif\n int f();\n};\nint after;", "a").found
    assert [(e["name"], e["end_line"]) for e in found if e["type"] == "class_decl"] == [("X", 7), ("X", 7)]
    assert ("var_decl", "after") in {(e["type"], e["name"]) for e in found}


def test_branches_that_differ_in_depth():
    code = '#ifdef __cplusplus\nextern "C" {\n#endif\nint a();\n#ifdef __cplusplus\n}\n#endif\nint b();'
    assert [r[:2] for r in rows(code)] == [("function_decl", "a"), ("function_decl", "b")]
    assert rows("#if 0\nint broken( { \n#endif\nint b;") == [("var_decl", "b", None)]
    assert rows("#if 1\nint a;\n#else\n}}}} int c(\n#endif\nint b;")[-1] == ("var_decl", "b", None)
    assert rows("void f() {\n#if A\n if (x) {\n#else\n {\n#endif\n } }\nint b;")[-1] == ("var_decl", "b", None)
    assert rows("#if A\n#if B\nint x;\n#endif\n#endif")[0][2] == "(A) && (B)"
    assert rows("#ifndef G_H\n#define G_H\nint x;\n#endif") == [("macro_definition", "G_H", None), ("var_decl", "x", None)]  # a guard is no condition
    assert rows("#else\n#endif\n#endif\nint x;") == [("var_decl", "x", None)]


def test_declarators():
    assert declared("int (*cb)(int);") == [("var_decl", "cb", "int (*)(int)", None)]
    assert declared("struct A { static int count; };\nint A::count = 0;")[1] == ("var_decl", "count", "int", "A")
    assert declared("struct {int a;} v;") == [("struct_decl", None, None, None), ("var_decl", "v", "struct", None)]
    assert declared("int (*table[3])(int), *(*deep)[2], plain;") == [("var_decl", "table", "int (*)(int)", None), ("var_decl", "deep", "int * (*)[2]", None), ("var_decl", "plain", "int", None)]
    assert declared("void (*signal(int sig, void (*func)(int)))(int);") == [("function_decl", "signal", "void (*)(int)", None)]
    assert declared("int A::*member = 0;") == [("var_decl", "member", "int A::*", None)]
    assert declared("MACRO(x)\nint f() { return 1; }\nint g();") == [("function_decl", "f", "int", None), ("function_decl", "g", "int", None)]
    assert declared("Foo x(1, 2), y{3};")[0] == ("var_decl", "x", "Foo", None)
    assert declared("F::F() try : a{1}, b(2) { g(); } catch (int) { } catch (...) { h(); }\nint z;") == [
        ("constructor", "F", "", "F"), ("cxx_try_stmt", None, None, "F"), ("cxx_catch_stmt", None, None, "F"), ("cxx_catch_stmt", None, None, "F"), ("var_decl", "z", "int", None),
    ]
    ends = [e["end_line"] for e in extract.Scanner("int f() try {\n}\ncatch (...) {\n}\nint z;", "a").found]
    assert ends[:1] == [4]


def test_rich_signatures():
    e = extract.Scanner("struct A { static int __stdcall f(const char *s, int &&r, Foo &q, int n[], void (*g)(int), const volatile int v); explicit A(int) noexcept; int h() volatile; };", "a").found
    f = next(x for x in e if x["name"] == "f")["rich"]
    assert f["storage_class"] == "static" and f["calling_convention"] == "stdcall"
    assert [(p["name"], p["type_kind"]) for p in f["parameters"]] == [("s", "pointer"), ("r", "rvalue_reference"), ("q", "lvalue_reference"), ("n", "array"), ("g", "function_pointer"), ("v", "value")]
    assert [p["is_const"] for p in f["parameters"]] == [True, False, False, False, False, True] and f["parameters"][5]["is_volatile"]
    assert next(x for x in e if x["type"] == "constructor")["rich"]["is_explicit"] and next(x for x in e if x["name"] == "h")["rich"]["is_volatile"]
    a = extract.Scanner("[[nodiscard, deprecated(\"x\")]] int f();", "a").found
    assert [x["name"] for x in a if x["type"] == "attribute"] == ["nodiscard", "deprecated"]


def test_depth_takes_linear_time():
    for code, n in (("namespace a{" * 100_000 + "int x;" + "}" * 100_000, 100_001), ("void f(){" + "{" * 100_000 + "}" * 100_000 + "}", 1), ("struct A{" * 20_000, 20_000), ("#if A\nint f(\n#else\nint g(\n#endif\nint x) {}\n" * 2000, 10_000)):
        begun = time.time()
        assert len(extract.Scanner(code, "a").found) == n
        assert time.time() - begun < 30


def test_no_text_breaks_it():
    r = random.Random(4)
    pieces = ["int ", "f", "(", ")", "{", "}", ";", "\n#if A\n", "\n#else\n", "\n#elif 0\n", "\n#endif\n", "class ", "X", ":", "::", "<", ">", "template ", "operator", "~", "*", "&", "[", "]", "=", ",", "try", "catch", '"s"', "'", "//", "/*", "*/", "using ", "namespace ", "enum ", "union ", "typedef ", "\\\n", "é"]
    for _ in range(3000):
        code = "".join(r.choice(pieces) for _ in range(r.randrange(60)))
        for e in extract.Scanner(code, "a").found:
            assert 0 <= e["start"] <= e["stop"] <= len(code), code


def test_one_poisoned_file(spark):
    files = [(f"f{i}.cpp", f"int g{i}();") for i in range(5)]
    skip = lambda place: 1 // int(place[1]) < 0  # noqa: E731 - fails on f0.cpp alone
    df = spark.createDataFrame(files, "location string, code string")
    assert sorted(r.name for r in extract.elements(df, skip=skip).collect()) == ["g1", "g2", "g3", "g4"]
    bad = extract.diagnostics(df, skip=skip).collect()
    assert [(r.location, r.severity) for r in bad] == [("f0.cpp", "Fatal")] and "ZeroDivisionError" in bad[0].message
    plan = extract.elements(df, repeated=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
