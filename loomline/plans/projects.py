"""Registered queries about whole projects and tables: includes, upserts, responses, siblings, names, indexes.

Each makes files or rows of the driver's tables, all of them, and has DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.operators import entities, extract, fragments, includes, retrieval, statements, symbols
from loomline.plans.catalogue import ORACLE, _TOP, _branched_files, _docs, _sql_overlapping, _t, query
from loomline.sources import model, sql, tables

# Includes --------------------------------------------------------------------------------------------------------


def _project(spark, sf_dir):
    """A header for each document, which includes two others, one by a path and one by a folder of headers, and one from outside."""
    place = lambda n: F.concat(F.lit("p/d"), n % 10, F.lit("/f"), n, F.lit(".h"))
    n, half, third = F.col("doc_id"), F.floor(F.col("doc_id") / 2), F.floor(F.col("doc_id") / 3)
    words = F.regexp_replace(F.col("text"), r"[*/\\]", " ")
    code = F.concat(F.lit("/* "), words, F.lit(' */\n#include "./../d'), half % 10, F.lit("/f"), half, F.lit('.h"\n#include <f'), third, F.lit(".h>\n#include <vector>\n"))
    return _docs(spark, sf_dir, "doc_id", "text").select(place(n).alias("location"), code.alias("code"))


_PLACE = "'p/d' || ({0} % 10) || '/f' || {0} || '.h'"
_EDGES = f"""d AS (SELECT doc_id AS n, len(string_split(text, chr(10))) AS top FROM documents),
    e AS (SELECT n, top + 1 AS line, n // 2 AS m, './../d' || (n // 2 % 10) || '/f' || (n // 2) || '.h' AS name FROM d UNION ALL SELECT n, top + 2, n // 3, 'f' || (n // 3) || '.h' FROM d UNION ALL SELECT n, top + 3, NULL, 'vector' FROM d)"""


def _edges(spark, sf_dir):
    files = _project(spark, sf_dir)
    return includes.edges(extract.elements(files, repeated=False, columns=("type", "name", "location", "line", "include_kind")), files, [f"p/d{i}" for i in range(10)])


@query(f"WITH {_EDGES} SELECT {_PLACE.format('e.n')} AS location, CAST(line AS INTEGER) AS line, name, {_PLACE.format('x.n')} AS target FROM e LEFT JOIN d x ON x.n = e.m")
def include_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT e.n, e.m FROM e JOIN d x ON x.n = e.m),
    r AS (SELECT n AS source, m AS header, 1 AS depth FROM s UNION SELECT source, m, depth + 1 FROM r JOIN s ON s.n = r.header WHERE depth < 40)
    SELECT {_PLACE.format("source")} AS source, {_PLACE.format("header")} AS header, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"""
)
def include_closure(spark, sf_dir):
    return includes.closure(_edges(spark, sf_dir))


# Tables that last ------------------------------------------------------------------------------------------------

@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def upserted_table(spark, sf_dir):
    """Events upserted into a table by user in several versions, one for each type; the newest version."""
    events = _t(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value", "ts")
    table = tables.Table(spark, tables.own_folder(spark), ["user_id"], 16)
    for r in events.select("event_type").distinct().orderBy("event_type").collect():
        table.upsert(events.where(F.col("event_type").eqNullSafe(r[0])), "ts", "event_id")
    return table.read().drop("ts")


def _client():
    """Stands for a model: says how long the prompt is."""
    return lambda prompts: [f"{len(p)} characters: {p[:20]}" for p in prompts]


@query("SELECT doc_id, length(p) || ' characters: ' || substr(p, 1, 20) AS response, false AS failed FROM (SELECT doc_id, lang || ' ' || source || ' ' || text AS p FROM documents)")
def stored_responses(spark, sf_dir):
    """Every document's prompt answered once by a store of responses, and then again from the store alone."""
    store = tables.Table(spark, tables.own_folder(spark), ["prompt_sha256"], 16)
    requests = _docs(spark, sf_dir, "doc_id", F.concat("lang", F.lit(" "), "source", F.lit(" "), "text").alias("prompt"))
    model.remembered(requests, store, _client, rounds=2)

    def gone():
        raise AssertionError("nothing is to be asked again")

    return model.remembered(requests, store, gone, tries=1).select("doc_id", "response", "failed")


# Siblings --------------------------------------------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, user_id, event_type, ts, CAST(event_id % 97 AS INTEGER) AS level, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
    w AS (SELECT event_type, n, level, list(level) OVER b AS before, list(event_id) OVER b AS named, list(level) OVER a AS after, list(event_id) OVER a AS later, event_id FROM e
    WINDOW b AS (PARTITION BY event_type ORDER BY n ROWS BETWEEN 400 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 400 FOLLOWING))
    SELECT event_id, level, list_last(list_filter(named, lambda x, i: before[i] <= level)) AS prev, list_first(list_filter(later, lambda x, i: after[i] <= level)) AS next FROM w"""
)
def deep_siblings(spark, sf_dir):
    """Ninety-seven levels in a handful of very long keys.

    The SQL looks 400 rows ahead and back only: on sf0.1 it has null for 28 links of 407 rows and more, which are given here.
    """
    rows = _t(spark, sf_dir, "events", "event_id", "event_type", "ts").withColumn("level", (F.col("event_id") % 97).cast("int"))
    return entities.siblings(rows, ["event_type"], ["ts", "event_id"], "level", None, "event_id").select("event_id", "level", "prev", "next")




# An index --------------------------------------------------------------------------------------------------------


@query(_TOP)
def index_topk(spark, sf_dir):
    """All vectors in inverted lists, written and read back; exact by the lists' radii."""
    rows, path = _t(spark, sf_dir, "embeddings", "vec_id", "embedding"), tables.own_folder(spark)
    retrieval.build_index(rows, path)
    return retrieval.search_index(spark, path, rows.where("vec_id % 100 = 0"), 3, None)


# SQL -------------------------------------------------------------------------------------------------------------


@query(f"SELECT location, type, name, line, end_line, condition, parent_name FROM ({ORACLE['branched_elements']})")
def sql_elements(spark, sf_dir):
    """The elements of the branched files by a lateral table function."""
    sql.register(spark)
    _branched_files(spark, sf_dir).createOrReplaceTempView("loomline_files")
    return spark.sql("SELECT f.location, e.type, e.name, e.line, e.end_line, e.condition, e.parent_name FROM loomline_files f, LATERAL elements(f.location, f.code) e")


@query(f"""SELECT doc_id, idx, start, "end" AS stop, code FROM ({ORACLE["fragments_overlap"]})""")
def sql_fragments(spark, sf_dir):
    sql.register(spark)
    _docs(spark, sf_dir, "doc_id", "text").createOrReplaceTempView("loomline_documents")
    return spark.sql("SELECT d.doc_id, f.idx, f.start, f.stop, f.code FROM loomline_documents d, LATERAL fragments(d.text, 400) f")


# Statements ------------------------------------------------------------------------------------------------------

#: A function for each document: {n} is the doc_id, {w} its text within a literal.
_BODY = """{
  const char *s = "{w}";
  if (a > {n}) { g(a); } else { h{n}(); }
  for (int i = 0; i < a; i++) k(i);
  while (a) a--;
  switch (a) { case 1: m(); default: o(); }
  auto l = [&](int z) { return z; };
  try { p(); } catch (...) { q(); }
  do { r(); } while (a < 3);
  return a; }"""
_FUNCTION = "int f{n}(int a) " + _BODY
#: What is in it.
_STATEMENTS = (
    ("function_decl", _FUNCTION), ("compound_stmt", _BODY), ("decl_stmt", 'const char *s = "{w}";'), ("if_stmt", "if (a > {n}) { g(a); } else { h{n}(); }"), ("compound_stmt", "{ g(a); }"), ("compound_stmt", "{ h{n}(); }"),
    ("for_stmt", "for (int i = 0; i < a; i++) k(i);"), ("while_stmt", "while (a) a--;"), ("switch_stmt", "switch (a) { case 1: m(); default: o(); }"), ("compound_stmt", "{ case 1: m(); default: o(); }"), ("case_stmt", "case 1: m();"), ("default_stmt", "default: o();"),
    ("decl_stmt", "auto l = [&](int z) { return z; };"), ("lambda_expr", "[&](int z) { return z; }"), ("compound_stmt", "{ return z; }"), ("cxx_try_stmt", "try { p(); } catch (...) { q(); }"), ("compound_stmt", "{ p(); }"),
    ("cxx_catch_stmt", "catch (...) { q(); }"), ("compound_stmt", "{ q(); }"), ("do_stmt", "do { r(); } while (a < 3);"), ("compound_stmt", "{ r(); }"),
)


def _sql_filled(text: str) -> str:
    quoted = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return f"replace(replace({quoted}, '{{n}}', n), '{{w}}', w)"


_STATED = f"""d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS n, regexp_replace(text, '["\\\\' || chr(10) || chr(13) || ']', ' ', 'g') AS w FROM documents), c AS (SELECT *, {_sql_filled(_FUNCTION)} AS code FROM d),
    s AS ({" UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, strpos(code, {_sql_filled(x)}) - 1 AS start, strpos(code, {_sql_filled(x)}) - 1 + length({_sql_filled(x)}) AS stop FROM c" for kind, x in _STATEMENTS)})"""


def _functions(spark, sf_dir):
    words = F.regexp_replace(F.col("text"), r'["\\\n\r]', " ")
    code = F.replace(F.replace(F.lit(_FUNCTION), F.lit("{n}"), F.col("doc_id").cast("string")), F.lit("{w}"), words)
    return _docs(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL").select("doc_id", code.alias("code"))


@query(f"WITH {_STATED} SELECT doc_id, kind, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM s")
def statement_tree(spark, sf_dir):
    """All statements of the functions, with their places."""
    return statements.table(_functions(spark, sf_dir), "doc_id", "code")


_POINTED = f"""base AS (WITH {_STATED} SELECT doc_id AS id, any_value(code) AS text, 150 AS target, list_sort(list_distinct(flatten(list([start, stop]) FILTER (kind <> 'function_decl')))) AS points FROM s JOIN c USING (doc_id) GROUP BY doc_id)"""


@query(f'WITH {_sql_overlapping("SELECT * FROM base", _POINTED, "points")} SELECT id AS doc_id, idx, start, stop AS "end", code FROM g')
def statement_fragments(spark, sf_dir):
    """Functions in pieces that end where statements begin and end."""
    rows = _functions(spark, sf_dir).withColumns({"target": F.lit(150), "kind": F.lit("function_decl")})
    return fragments.fragments(rows, "doc_id", "code", fragments.split_statements, "target", "kind")


# Names -----------------------------------------------------------------------------------------------------------

_LIBRARY = "namespace lib{n} {\nnamespace in { struct S { void f(); void h(); }; }\nstruct T { void g(); };\nnamespace deep { struct T { void g(); }; }\n}\nstruct T { void g(); };\n"
_USER = "void in::S::f() {}\nusing namespace lib{n};\nnamespace al = lib{n}::in;\nvoid in::S::f() {}\nvoid al::S::h() {}\nnamespace lib{n} { namespace deep { void T::g() {} } void T::g() {} void ::T::g() {} }\nvoid lib{n}::deep::T::g() {}\nusing lib{n}::deep::T;\nvoid None::z() {}\n"
#: Of the second file: (line, name, whole name of the owner, line of the owner in the first file).
_OWNED = ((1, "f", None, None), (4, "f", "lib{n}::in::S", 2), (5, "h", "lib{n}::in::S", 2), (6, "g", "lib{n}::deep::T", 4), (6, "g", "lib{n}::T", 3), (6, "g", "T", 6), (7, "g", "lib{n}::deep::T", 4), (9, "z", None, None))


def _named_files(spark, sf_dir):
    """A header and a source for each document, also for one without text; a comment with the text comes last."""
    n = F.col("doc_id").cast("string")
    words = F.concat(F.lit("/* "), F.coalesce(F.regexp_replace("text", r"[*/\\]", " "), F.lit("")), F.lit(" */\n"))
    put = lambda text: F.concat(F.replace(F.lit(text), F.lit("{n}"), n), words)
    both = F.array(F.struct(F.concat(F.lit("l/"), n, F.lit(".h")).alias("location"), put(_LIBRARY).alias("code")), F.struct(F.concat(F.lit("u/"), n, F.lit(".cpp")).alias("location"), put(_USER).alias("code")))
    return _docs(spark, sf_dir, "doc_id", "text").select(F.explode(both).alias("x")).select("x.*")


def _sql_owned() -> str:
    put = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"replace('{x}', '{{n}}', CAST(doc_id AS VARCHAR))"
    row = lambda line, name, whole, at: f"SELECT 'u/' || doc_id || '.cpp' AS location, {line} AS line, '{name}' AS name, {put(whole)} AS qualified, {'CAST(NULL AS VARCHAR)' if at is None else LIB if whole != 'T' else FIRST} AS owner_location, {'CAST(NULL AS INTEGER)' if at is None else at} AS owner_line FROM documents"
    return " UNION ALL ".join(row(*r) for r in _OWNED)


LIB, FIRST = "'l/' || doc_id || '.h'", "(SELECT min('l/' || doc_id || '.h') FROM documents)"


@query(_sql_owned())
def resolved_names(spark, sf_dir):
    """Members defined in one file, their classes in another: by enclosing scopes, using-directives and aliases."""
    out = symbols.owned(extract.elements(_named_files(spark, sf_dir), repeated=False, columns=symbols.COLUMNS))
    return out.select("location", "line", "name", "qualified", F.col("symbol.location").alias("owner_location"), F.col("symbol.line").alias("owner_line"))


@query("SELECT 'u/' || doc_id || '.cpp' AS location, 2 AS line, 'lib' || doc_id AS namespace, 'lib' || doc_id AS qualified, 'l/' || doc_id || '.h' AS opened_in FROM documents")
def using_directives(spark, sf_dir):
    return symbols.directives(extract.elements(_named_files(spark, sf_dir), repeated=False, columns=symbols.COLUMNS, strict=True))
