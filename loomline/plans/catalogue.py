"""The registered queries over the driver's tables, each with DuckDB SQL that gives the same rows.

``documents.text`` has no comments or code in it; queries on code wrap it into a synthetic file first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import keys
from loomline.functions import text as T
from loomline.operators import diffs, entities, extract, fragments, instructions, lines, profile, records, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "clean_code_profile"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if SQL can express it."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _t(spark, sf_dir, "documents", *columns)


def _code() -> Column:
    """A documented one-line function around each document."""
    return F.concat(F.lit("/** "), F.col("text"), F.lit(" */\nint  f"), F.col("doc_id"), F.lit("( int a ) ; // "), F.col("source"), F.lit("\n"))


_CODE = "'/** ' || text || ' */' || chr(10) || 'int  f' || doc_id || '( int a ) ; // ' || source || chr(10)"
_BLANKS = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"


def _sql_clean_code(c: str) -> str:
    for pattern, to in ((r"(?s)/\*.*?\*/", ""), (r"//[^\n]*", ""), (r"[ \t]+", " "), (r" ([<>{}\[\]();,&*:])", r"\1"), (r"([<>{}\[(:*&]) ", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: trim(x, {_BLANKS})), lambda x: x <> ''), chr(10))"


def _sql_tokens(c: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, '[A-Za-z0-9_]+|[^A-Za-z0-9_ \\t\\r\\n\\f]')) AS BIGINT)"


def _sql_replace(c: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        c = f"regexp_replace({c}, '{pattern}', {to}, 'g')"
    return c


# Text ------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_sql_clean_code(_CODE)} AS code FROM documents")
def clean_code_text(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", T.clean_cpp_code(_code()).alias("code"))


_DOCSTRING = _sql_replace(
    "'/**' || chr(10) || '****' || chr(10) || ' * ' || replace(text, '. ', '.  ' || chr(10) || '  *  ') || chr(10) || '---' || chr(10) || ' */'",
    (r"(?m)^[*+-]+$", "''"),
    (r"(?m)^/\*\*|\*/", "''"),
    (r"(?m)^[ \t\r\n\f]*\* ?", "''"),
    (r"(?m)^-+$", "''"),
    (r"[ \t]{2,}", "' '"),
    (r" *\n *", "chr(10)"),
    (r"\n{2,}", "chr(10)"),
    (r"(?m)^[*+-]+$", "''"),
    (r"\n{2,}", "chr(10)"),
)


@query(f"SELECT doc_id, trim({_DOCSTRING}, {_BLANKS} || chr(10)) AS docstring FROM documents")
def clean_docstring_text(spark, sf_dir):
    doc = F.concat(F.lit("/**\n****\n * "), F.replace("text", F.lit(". "), F.lit(".  \n  *  ")), F.lit("\n---\n */"))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.clean_docstring(doc).alias("docstring"))


_COMMENT = "'//-----' || chr(10) || '//  ' || replace(text, '. ', '.' || chr(10) || '//-+ ') || ' @{ x @}' || chr(10) || '//' || chr(10) || '//==='"


@query(
    f"""SELECT doc_id, trim(regexp_replace(array_to_string(list_filter(list_transform(list_filter(list_transform(string_split({_COMMENT}, chr(10)),
    lambda x: trim(x, {_BLANKS})), lambda x: x <> '' AND NOT regexp_matches(x, '^//[-+=]+[ \\t]*$') AND NOT regexp_matches(x, '^//[-+]*[ \\t]*$')),
    lambda x: trim(regexp_replace(regexp_replace(x, '^//[-+]*[ \\t]*', ''), '@[{{}}]', '', 'g'), {_BLANKS})), lambda x: x <> ''), ' '),
    '[ \\t\\r\\f]+', ' ', 'g'), {_BLANKS} || chr(10)) AS comment FROM documents"""
)
def clean_comment_text(spark, sf_dir):
    comment = F.concat(F.lit("//-----\n//  "), F.replace("text", F.lit(". "), F.lit(".\n//-+ ")), F.lit(" @{ x @}\n//\n//==="))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.clean_comment(comment).alias("comment"))


_INDENT = "chr(10) || '  ' || chr(10) || chr(9) || replace(text, '. ', '.  ' || chr(10) || chr(10) || chr(9) || chr(10) || chr(10) || chr(9)) || chr(10) || ' '"


@query(
    f"""SELECT doc_id, regexp_replace(replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_INDENT}, chr(10)),
    lambda x: rtrim(x, {_BLANKS})), chr(10)), '^\\n+', ''), '\\n+$', ''), chr(9), '    '), '\\n{{3,}}', chr(10) || chr(10), 'g') AS code FROM documents"""
)
def normalize_indent(spark, sf_dir):
    code = F.concat(F.lit("\n  \n\t"), F.replace("text", F.lit(". "), F.lit(".  \n\n\t\n\n\t")), F.lit("\n "))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.normalize_indent(code).alias("code"))


@query(
    f"""SELECT doc_id, trim(array_to_string(list_filter(string_split(replace(text, '. ', '.' || chr(10) || '# '), chr(10)), lambda x: NOT starts_with(x, '#')), chr(10)),
    {_BLANKS} || chr(10)) AS text FROM documents"""
)
def drop_hash_lines(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.drop_hash_lines(F.replace("text", F.lit(". "), F.lit(".\n# "))).alias("text"))


@query(
    f"""SELECT doc_id, array_to_string(regexp_extract_all({_CODE} || '\"\"\"' || source || '\"\"\" x', '(?s)(\"\"\".*?\"\"\"|''''''.*?''''''|/\\*\\*.*?\\*/)'), chr(10)) AS docstring FROM documents"""
)
def docstring_blocks(spark, sf_dir):
    text = F.concat(_code(), F.lit('"""'), F.col("source"), F.lit('""" x'))
    return _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", T.docstring_blocks(text).alias("docstring"))


_ANSWER = "'draft' || chr(10) || '@note b' || chr(10) || text || chr(10) || ' @brief ' || source || chr(10) || '@note b' || chr(10) || '@return' || ' tail'"


@query(
    f"""WITH a AS (SELECT doc_id, {_ANSWER} AS c FROM documents), b AS (SELECT doc_id, substr(c, strpos(c, '@brief')) AS c FROM a),
    l AS (SELECT doc_id, unnest(string_split(substr(c, 1, strpos(c, '@return') + 6), chr(10))) AS line, generate_subscripts(string_split(substr(c, 1, strpos(c, '@return') + 6), chr(10)), 1) AS i FROM b),
    f AS (SELECT doc_id, trim(line, {_BLANKS}) AS bare, arg_min(line, i) AS line, min(i) AS i FROM l WHERE trim(line, {_BLANKS}) <> '' GROUP BY ALL)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS response FROM f GROUP BY doc_id"""
)
def clean_response(spark, sf_dir):
    text = F.concat(F.lit("draft\n@note b\n"), F.col("text"), F.lit("\n @brief "), F.col("source"), F.lit("\n@note b\n@return tail"))
    return _docs(spark, sf_dir, "doc_id", "text", "source").select("doc_id", T.clean_response(text).alias("response"))


@query(
    f"""SELECT doc_id, trim(substr(c, 1, strpos(c, '{{') - 1), {_BLANKS} || chr(10)) AS declaration, trim(substr(c, strpos(c, '{{')), {_BLANKS} || chr(10)) AS body
    FROM (SELECT doc_id, 'int f' || doc_id || '(int a) {{ ' || text || ' }}' AS c FROM documents)"""
)
def decl_body_split(spark, sf_dir):
    code = F.concat(F.lit("int f"), F.col("doc_id"), F.lit("(int a) { "), F.col("text"), F.lit(" }"))
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", T.split_declaration(code).alias("x")).select("doc_id", "x.declaration", "x.body")


_THOUGHT = "'<think>' || text || '</think> ' || role || ' </think> ' || conv_id || ' '"


@query(
    f"""SELECT conv_id, turn, trim(substr(c, strpos(c, '</think>') + 8), {_BLANKS} || chr(10)) AS first_cut, trim(string_split(c, '</think>')[-1], {_BLANKS} || chr(10)) AS last_cut
    FROM (SELECT conv_id, turn, {_THOUGHT} AS c FROM conversations)"""
)
def strip_reasoning(spark, sf_dir):
    c = F.concat(F.lit("<think>"), F.col("text"), F.lit("</think> "), F.col("role"), F.lit(" </think> "), F.col("conv_id"), F.lit(" "))
    return _t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "turn", T.strip_reasoning(c).alias("first_cut"), T.strip_reasoning(c, last=True).alias("last_cut"))


@query(
    f"""SELECT doc_id, {_sql_tokens("text")} AS tokens, CAST(floor(tokens * 3.5) AS BIGINT) AS est_chars, round(0.8 * length(text) / greatest(tokens, 1), 6) AS chars_per_token FROM documents"""
)
def token_counts(spark, sf_dir):
    tokens = T.token_count(F.col("text"))
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", F.length("text").alias("n"), tokens.alias("tokens"))
    return rows.select("doc_id", "tokens", F.floor(F.col("tokens") * 3.5).cast("long").alias("est_chars"), F.round(0.8 * F.col("n") / F.greatest("tokens", F.lit(1)), 6).alias("chars_per_token"))


# Identifiers -----------------------------------------------------------------------------------------------------

_ID = """SELECT doc_id, kind, path, n_chars AS line, doc_id % 80 AS col, CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'f' || doc_id END AS name
    FROM (SELECT *, upper(lang) || '_DECL' AS kind, source || '/a:b.cpp' AS path FROM documents)"""


@query(
    f"""WITH e AS ({_ID}), n AS (SELECT *, CASE WHEN name = '' THEN substr(kind, 1, 5) || '-' || path || '-' || line || '-' || col ELSE name END AS made FROM e)
    SELECT doc_id, made AS name, substr(kind, 1, 5) || '_' || substr(sha256(CASE WHEN name = '' THEN made ELSE kind || '-' || replace(path, ':', '_') || '-' || line || '-' || col || '-' || made END), 1, 12) AS id FROM n"""
)
def element_ids(spark, sf_dir):
    kind, path, line, col = F.concat(F.upper("lang"), F.lit("_DECL")), F.concat("source", F.lit("/a:b.cpp")), F.col("n_chars"), F.col("doc_id") % 80
    name = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(F.lit("f"), F.col("doc_id")))
    return _docs(spark, sf_dir).select("doc_id", keys.generated_name(kind, name, path, line, col).alias("name"), keys.element_id(kind, name, path, line, col).alias("id"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'class_decl_' || source || '_' END || 'f' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '_const_' ELSE '' END ||
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE '_int_' || lang END AS function_key, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'class_decl_' || source || '_' END || 'enum_decl_f' || doc_id AS class_key,
    'f' || doc_id || ':int:' || lang AS overload_id FROM documents"""
)
def entity_keys(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "translation_unit").otherwise("class_decl")
    name = F.concat(F.lit("f"), F.col("doc_id"))
    types = F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("int"), F.col("lang")))
    return _docs(spark, sf_dir, "doc_id", "lang", "source").select(
        "doc_id",
        keys.function_key(kind, F.col("source"), name, F.col("doc_id") % 2 == 0, types).alias("function_key"),
        keys.class_key(kind, F.col("source"), F.lit("enum_decl"), name).alias("class_key"),
        keys.overload_id(name, F.array(F.lit("int"), F.col("lang"))).alias("overload_id"),
    )


# Lines -----------------------------------------------------------------------------------------------------------

_LINES = "SELECT doc_id, unnest(string_split({0}, chr(10))) AS line, generate_subscripts(string_split({0}, chr(10)), 1) AS line_no FROM documents"


@query(
    f"""WITH l AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, trim(line, {_BLANKS}) AS line FROM ({_LINES.format("text")}))
    SELECT doc_id, line_no, coalesce(string_agg(line, chr(10) ORDER BY line_no) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context_before,
    string_agg(line, chr(10) ORDER BY line_no) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS context_after FROM l"""
)
def line_context(spark, sf_dir):
    return lines.with_context(_docs(spark, sf_dir, "doc_id", "text"), "doc_id")


@query(
    f"""WITH l AS ({_LINES.format("text")}) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
    CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(line) AS INTEGER) AS length FROM l"""
)
def line_offsets(spark, sf_dir):
    return lines.offsets(_docs(spark, sf_dir, "doc_id", "text"), "doc_id")


_COMMENTED = "'/** ' || replace(text, '. ', '.' || chr(10)) || ' */' || chr(10) || 'int f; // no' || chr(10) || '  // ' || source || chr(10) || '/// ' || lang || chr(10) || 'a /* b */' || chr(10) || '/* lost' || chr(10) || 'x'"


@query(
    f"""WITH l AS ({_LINES.format(_COMMENTED)}),
    m AS (SELECT *, contains(line, '/*') AND NOT contains(line, '*/') AS o, contains(line, '*/') AND NOT contains(line, '/*') AS c, contains(line, '/*') AND contains(line, '*/') AS closed FROM l),
    s AS (SELECT *, coalesce(last_value(CASE WHEN o THEN 1 WHEN c THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inside FROM m),
    g AS (SELECT *, o AND NOT inside AS begins, sum(CASE WHEN o AND NOT inside THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM s),
    r AS (SELECT doc_id, min(line_no) AS line_no, 'block' AS type, string_agg(line, chr(10) ORDER BY line_no) AS text FROM g WHERE inside OR begins GROUP BY doc_id, block HAVING bool_or(c)
    UNION ALL SELECT doc_id, line_no, 'block', line FROM g WHERE NOT inside AND closed
    UNION ALL SELECT doc_id, line_no, 'line', line FROM g WHERE NOT inside AND NOT begins AND NOT closed AND NOT c AND starts_with(trim(line, {_BLANKS}), '//'))
    SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, type, text, CASE WHEN regexp_matches(ltrim(text, {_BLANKS}), '^(/\\*\\*|/\\*!|///|//!)') THEN 'docstring' ELSE 'comment' END AS class FROM r"""
)
def comment_lines(spark, sf_dir):
    text = F.concat(F.lit("/** "), F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(" */\nint f; // no\n  // "), F.col("source"), F.lit("\n/// "), F.col("lang"), F.lit("\na /* b */\n/* lost\nx"))
    return lines.comments(_docs(spark, sf_dir, "doc_id", "text", "source", "lang").select("doc_id", text.alias("text")), "doc_id")


@query(
    f"""WITH t AS ({_LINES.format("text")}), l AS (SELECT doc_id, 2 * line_no AS line_no, trim(line, {_BLANKS}) AS line FROM t
    UNION ALL SELECT doc_id, 2 * line_no - 1, 'Class ''L' || line_no % 3 || ''' : method m' || line_no % 4 FROM t WHERE line_no % 5 = 1
    UNION ALL SELECT doc_id, 0, 'preamble' FROM documents),
    s AS (SELECT *, sum(CASE WHEN starts_with(line, 'Class ''L') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM l),
    d AS (SELECT doc_id, section, min(line) FILTER (starts_with(line, 'Class ''L')) AS head, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT starts_with(line, 'Class ''L')) AS doc FROM s WHERE section > 0 GROUP BY ALL)
    SELECT doc_id, substr(head, 8, 2) AS class_name, regexp_extract(head, 'method (\\w+)', 1) AS method, arg_max(trim(doc, {_BLANKS} || chr(10)), section) AS doc FROM d GROUP BY ALL"""
)
def section_fold(spark, sf_dir):
    rows = lines.explode_lines(_docs(spark, sf_dir, "doc_id", "text"), "doc_id")
    n = F.col("line_no")
    body = rows.select("doc_id", (2 * n).alias("line_no"), "line")
    head = rows.where(n % 5 == 1).select("doc_id", (2 * n - 1).alias("line_no"), F.concat(F.lit("Class 'L"), n % 3, F.lit("' : method m"), n % 4).alias("line"))
    start = _docs(spark, sf_dir, "doc_id").select("doc_id", F.lit(0).alias("line_no"), F.lit("preamble").alias("line"))
    return lines.sections(body.unionByName(head).unionByName(start), "doc_id")


# Entities --------------------------------------------------------------------------------------------------------

_ENTITY = "SELECT d.doc_id, d.source || '_' || d.lang || '_' || d.doc_id % 9 AS key, coalesce(l.quality = 1, false) AS is_defined FROM documents d LEFT JOIN labels l USING (doc_id)"
_FOLD = f"SELECT key, count(*) FILTER (is_defined) AS def_cnt, count(*) FILTER (NOT is_defined) AS decl_cnt, min(doc_id) FILTER (is_defined) AS first_def, min(doc_id) FILTER (NOT is_defined) AS first_decl FROM ({_ENTITY}) GROUP BY key"


def _folded(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "source", "lang").join(_t(spark, sf_dir, "labels", "doc_id", "quality"), "doc_id", "left")
    key = F.concat_ws("_", "source", "lang", (F.col("doc_id") % 9).cast("string"))
    rows = rows.select("doc_id", key.alias("key"), (F.col("quality") == 1).alias("is_defined"), "source")
    return entities.fold(rows, ["key"], "doc_id", F.col("is_defined"), "doc_id", "source")


@query(_FOLD)
def fold_definitions(spark, sf_dir):
    return _folded(spark, sf_dir).select("key", "def_cnt", "decl_cnt", F.col("definition.doc_id").alias("first_def"), F.col("declaration.doc_id").alias("first_decl"))


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN def_cnt = 0 THEN 'undefined' WHEN def_cnt > 1 THEN 'multi_defined' WHEN decl_cnt > 1 THEN 'multi_declared' ELSE 'ok' END AS status FROM ({_FOLD})) GROUP BY status")
def review_status(spark, sf_dir):
    return profile.counts(_folded(spark, sf_dir).select(entities.review_status().alias("status")), "status")


@query(f"SELECT key, first_def FROM ({_FOLD}) WHERE def_cnt = 1 AND decl_cnt <= 1")
def single_definition_only(spark, sf_dir):
    return _folded(spark, sf_dir).where(entities.unique_definition()).select("key", F.col("definition.doc_id").alias("first_def"))


@query(
    f"""SELECT f.key, coalesce(nullif(CASE WHEN f.first_def % 2 = 0 THEN '' ELSE a.source END, ''), nullif(b.source, '')) AS docstring FROM ({_FOLD}) f LEFT JOIN documents a ON a.doc_id = f.first_def LEFT JOIN documents b ON b.doc_id = f.first_decl"""
)
def docstring_fallback(spark, sf_dir):
    own = F.when(F.col("definition.doc_id") % 2 == 0, "").otherwise(F.col("definition.source"))
    return _folded(spark, sf_dir).select("key", entities.first_text(own, F.col("declaration.source")).alias("docstring"))


@query("SELECT md5(text) AS hash, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY md5(text)")
def dedup_first(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text", "source").select(F.md5("text").alias("hash"), "doc_id", "source")
    return entities.first_of(rows, ["hash"], "doc_id")


@query("SELECT lang || source AS key, count(*) AS def_cnt, min(doc_id) AS first_id FROM documents GROUP BY lang || source")
def fold_classes(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "lang", "source").select(F.concat("lang", "source").alias("key"), "doc_id")
    return entities.fold_first(rows, ["key"], "doc_id", "doc_id").select("key", "def_cnt", F.col("definition.doc_id").alias("first_id"))


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark, sf_dir):
    rows = _t(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value", "ts")
    return entities.latest(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def resume_pending(spark, sf_dir):
    return entities.pending(_docs(spark, sf_dir, "doc_id", "lang"), _t(spark, sf_dir, "labels", "doc_id"), "doc_id")


_TURN = "SELECT conv_id, turn, role, min(text) AS text FROM conversations GROUP BY ALL"
_ROLES = ("user", "assistant", "system")


@query(
    "SELECT conv_id, turn, coalesce(a.text, '') AS run_0, coalesce(b.text, '') AS run_1, coalesce(c.text, '') AS run_2 FROM (SELECT DISTINCT conv_id, turn FROM conversations)"
    + "".join(f" LEFT JOIN (SELECT conv_id, turn, text FROM ({_TURN}) WHERE role = '{r}') {n} USING (conv_id, turn)" for n, r in zip("abc", _ROLES, strict=True))
)
def doc_compare(spark, sf_dir):
    """Every turn, with the text of each role as a run."""
    rows = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    one = rows.groupBy("conv_id", "turn", "role").agg(F.min("text").alias("text"))
    runs = [one.where(F.col("role") == r).select("conv_id", "turn", "text") for r in _ROLES]
    every = rows.select("conv_id", "turn").distinct().join(runs[0], ["conv_id", "turn"], "left")
    return entities.compare_runs([every, *runs[1:]], ["conv_id", "turn"], "text")


@query(
    """SELECT o_orderkey, len(list(l_partkey)) AS n_children, array_to_string(list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey), ',') AS children
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey"""
)
def parent_children(spark, sf_dir):
    parents = _t(spark, sf_dir, "orders", "o_orderkey")
    items = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), "l_partkey")
    out = entities.attach(parents, items, "o_orderkey", F.col("l_partkey"), "place").where(F.size("children") > 0)
    return out.select("o_orderkey", F.size("children").cast("long").alias("n_children"), F.array_join(F.transform("children", lambda x: x.cast("string")), ",").alias("children"))


@query("SELECT p_type, count(DISTINCT p_brand) AS overload_count, count(DISTINCT p_brand) > 1 AS is_overloaded FROM part GROUP BY p_type")
def overload_count(spark, sf_dir):
    return entities.overloads(_t(spark, sf_dir, "part", "p_type", "p_brand"), ["p_type"], "p_brand")


_LEVEL = "SELECT event_id, user_id, ts, CAST(length(event_type) % 3 AS INTEGER) AS level FROM events"
_NEAR = "CASE level " + " ".join(f"WHEN {k} THEN last_value(CASE WHEN level <= {k} THEN event_id END IGNORE NULLS) OVER {{0}}" for k in range(3)) + " END"


@query(
    f"""SELECT event_id, level, {_NEAR.format("b")} AS prev, {_NEAR.format("a")} AS next FROM ({_LEVEL})
    WINDOW b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def prev_next_sibling(spark, sf_dir):
    rows = _t(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type").select("event_id", "user_id", "ts", (F.length("event_type") % 3).alias("level"))
    return entities.siblings(rows, ["user_id"], ["ts", "event_id"], "level", 3, "event_id").select("event_id", "level", "prev", "next")


# Profiles --------------------------------------------------------------------------------------------------------

_LENGTHS = f"SELECT doc_id, lang, source, {_sql_tokens(_sql_clean_code(_CODE))} AS n FROM documents"


def _lengths(spark, sf_dir):
    return _docs(spark, sf_dir, "doc_id", "lang", "source", "text").select("doc_id", "lang", "source", T.token_count(T.clean_cpp_code(F.concat(F.col("text"), F.lit("\n"), _code()))).alias("n"))


_PROFILE = f"SELECT doc_id, lang, source, {_sql_tokens(_sql_clean_code('text || chr(10) || ' + _CODE))} AS n FROM documents"
_WHERE = "'f' || doc_id || ' in ' || source"


@query(f"SELECT lang, min(n) AS min_len, arg_min({_WHERE}, (n, doc_id)) AS min_at, max(n) AS max_len, arg_max({_WHERE}, (n, -doc_id)) AS max_at, count(*) AS n FROM ({_PROFILE}) GROUP BY lang")
def clean_code_profile(spark, sf_dir):
    at = F.concat(F.lit("f"), F.col("doc_id"), F.lit(" in "), F.col("source"))
    return profile.extremes(_lengths(spark, sf_dir), ["lang"], "n", at, "doc_id")


@query("SELECT lang, source, min(n_chars) AS min_len, arg_min(doc_id, (n_chars, doc_id)) AS min_at, max(n_chars) AS max_len, arg_max(doc_id, (n_chars, -doc_id)) AS max_at, count(*) AS n FROM documents GROUP BY lang, source")
def length_extremes(spark, sf_dir):
    return profile.extremes(_docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars"), ["lang", "source"], "n_chars", F.col("doc_id"), "doc_id")


@query("SELECT lang || source AS name, arg_max(n_chars, doc_id) AS length, CAST(len(string_split(arg_max(text, doc_id), chr(10))) AS INTEGER) AS n_lines FROM documents GROUP BY 1")
def last_lengths(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars", "text").withColumn("name", F.concat("lang", "source"))
    return profile.last_lengths(rows, ["name"], "doc_id", "text", "n_chars")


@query(
    """SELECT lang, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((n_chars - lo) * 50 / nullif(hi - lo, 0)), 49) END AS BIGINT) AS bin, count(*) AS n
    FROM (SELECT *, min(n_chars) OVER (PARTITION BY lang) AS lo, max(n_chars) OVER (PARTITION BY lang) AS hi FROM documents WHERE n_chars IS NOT NULL) GROUP BY ALL"""
)
def length_histogram(spark, sf_dir):
    return profile.histogram(_docs(spark, sf_dir, "lang", "n_chars"), "lang", "n_chars")


@query("SELECT k AS lang, coalesce(n, 0) AS n FROM (SELECT unnest(['de', 'en', 'es', 'fr', 'xx']) AS k) LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) ON k = lang")
def type_counts(spark, sf_dir):
    return profile.counts(_docs(spark, sf_dir, "lang"), "lang", ["de", "en", "es", "fr", "xx"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def kind_counts_desc(spark, sf_dir):
    return profile.counts(_t(spark, sf_dir, "events", "event_type"), "event_type").orderBy(F.col("n").desc(), "event_type")


@query(
    """SELECT doc_id, bucket, CAST((row_number() OVER (PARTITION BY bucket ORDER BY n_chars, doc_id) - 1) // CASE bucket WHEN 'short' THEN 4 WHEN 'medium' THEN 2 ELSE 1 END AS BIGINT) AS batch
    FROM (SELECT doc_id, n_chars, CASE WHEN n_chars <= 1500 THEN 'short' WHEN n_chars <= 3000 THEN 'medium' ELSE 'long' END AS bucket FROM documents)"""
)
def length_bucket_batches(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "n_chars").withColumn("bucket", T.length_bucket(F.col("n_chars")))
    size = F.when(F.col("bucket") == "short", 4).when(F.col("bucket") == "medium", 2).otherwise(1)
    return profile.batches(rows, "bucket", ["n_chars", "doc_id"], size).select("doc_id", "bucket", "batch")


@query(
    """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || doc_id), doc_id) <= floor(count(*) OVER () * 0.1) THEN 'test' ELSE 'train' END AS split FROM documents"""
)
def train_test_split(spark, sf_dir):
    return profile.split_exactly(_docs(spark, sf_dir, "doc_id"), "doc_id")


_IDS = "list_transform(string_split(text, ' '), lambda x: CAST(length(x) AS BIGINT))"


@query(f"SELECT doc_id, len(x) > 512 AS is_truncated, array_to_string(list_resize(x, 512, 0)[1:512], ',') AS ids FROM (SELECT doc_id, {_IDS} AS x FROM documents)")
def truncation_flags(spark, sf_dir):
    ids = F.transform(F.split("text", " "), lambda x: F.length(x).cast("long"))
    rows = _docs(spark, sf_dir, "doc_id", "text").select("doc_id", ids.alias("x"))
    return rows.select("doc_id", profile.truncated(F.col("x")).alias("is_truncated"), F.array_join(profile.padded(F.col("x"), 512, 0).cast("array<string>"), ",").alias("ids"))


@query(
    f"""SELECT conv_id, turn, array_to_string(list_concat(list_concat(x, y), [99]), ',') AS ids FROM (SELECT conv_id, turn, {_IDS} AS x, lead({_IDS}) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS y FROM conversations) WHERE x IS NOT NULL AND y IS NOT NULL"""
)
def sequence_concat(spark, sf_dir):
    """Each row of a conversation with the next one."""
    rows = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    ids = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x).cast("long"))
    both = rows.withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where("text is not null and next is not null")
    return both.select("conv_id", "turn", F.array_join(profile.joined_sequence(ids(F.col("text")), ids(F.col("next")), 99).cast("array<string>"), ",").alias("ids"))


# Instructions ----------------------------------------------------------------------------------------------------

_PARTS = {
    "instruction": "'Write the C++ function f' || doc_id",
    "location": "' located at file: ' || source || ', line:' || n_chars",
    "context": "CASE WHEN lang <> 'fr' THEN chr(10) || 'Context before is: \"' || source || ' ' || text || '\"' END",
    "docstring": "chr(10) || source || ' of ' || lang",
    "comments": "chr(10) || text",
}
_BUDGET = f"""WITH p AS (SELECT doc_id, {", ".join(f"coalesce({v}, '') AS p{i}" for i, v in enumerate(_PARTS.values()))} FROM documents),
    t AS (SELECT *, {", ".join(f"{_sql_tokens(f'p{i}')} AS t{i}" for i in range(5))} FROM p), s AS (SELECT *, t0 + t1 + t2 + t3 + t4 AS a FROM t),
    r AS (SELECT *, CASE WHEN a > 512 THEN a - t4 ELSE a END AS b FROM s), q AS (SELECT *, CASE WHEN b > 512 THEN b - t2 ELSE b END AS c FROM r),
    z AS (SELECT *, CASE WHEN c > 512 THEN c - t1 ELSE c END AS d FROM q)
    SELECT doc_id, p0 || CASE WHEN c <= 512 THEN p1 ELSE '' END || CASE WHEN b <= 512 THEN p2 ELSE '' END || p3 || CASE WHEN a <= 512 THEN p4 ELSE '' END AS prompt, d > 512 AS too_long FROM z"""


@query(_BUDGET)
def prompt_budget(spark, sf_dir):
    parts = {
        "instruction": F.concat(F.lit("Write the C++ function f"), F.col("doc_id")),
        "location": F.concat(F.lit(" located at file: "), F.col("source"), F.lit(", line:"), F.col("n_chars")),
        "context": F.when(F.col("lang") != "fr", F.concat(F.lit('\nContext before is: "'), F.col("source"), F.lit(" "), F.col("text"), F.lit('"'))),
        "docstring": F.concat(F.lit("\n"), F.col("source"), F.lit(" of "), F.col("lang")),
        "comments": F.concat(F.lit("\n"), F.col("text")),
    }
    return instructions.budgeted(_docs(spark, sf_dir), parts).select("doc_id", "prompt", "too_long")


_KINDS = ("function_decl", "cxx_method", "constructor", "destructor", "class_decl", "var_decl", "enum_decl", "function_template")
_MODES = ("whole", "first", "next", "last", "docstring")
_WORDING = (
    """WITH e AS (SELECT doc_id, ['function_decl','cxx_method','constructor','destructor','class_decl','var_decl','enum_decl','function_template'][1 + doc_id % 8] AS k, ['whole','first','next','last','docstring'][1 + doc_id % 5] AS m,
    'f' || doc_id AS n, source AS p, doc_id % 3 = 0 AS in_class, ['Write','Create','Develop','Provide implementation of','Produce'][1 + CAST(concat('0x', substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 5] AS v FROM documents),
    w AS (SELECT *, CASE WHEN k = 'cxx_method' OR (k = 'function_template' AND in_class) THEN 'method ' || n || ' of the C++ class ' || p WHEN k IN ('function_decl', 'function_template') THEN 'C++ function ' || n
    WHEN k IN ('constructor', 'destructor') THEN k || ' of the C++ class ' || p WHEN k = 'class_decl' THEN 'C++ class ' || n WHEN k = 'var_decl' THEN 'variable ' || n || ' of the project sources' ELSE 'enumeration ' || n || ' of the project sources' END AS what FROM e)
    SELECT doc_id, k AS kind, m AS mode, CASE WHEN m = 'docstring' THEN 'Write documentation (docstring) for the ' || what ELSE CASE WHEN k IN ('var_decl', 'enum_decl') THEN 'Declare' ELSE v END ||
    CASE m WHEN 'first' THEN ' the first fragment of' WHEN 'last' THEN ' the last fragment of' WHEN 'next' THEN CASE WHEN k IN ('function_decl', 'class_decl') OR (k = 'function_template' AND NOT in_class) THEN ' fragment (#' ELSE ' the next fragment (#' END || doc_id % 7 || ') of' ELSE '' END
    || ' the ' || what END AS instruction FROM w"""
)


@query(_WORDING)
def instruction_pairs(spark, sf_dir):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    rows = _docs(spark, sf_dir, "doc_id", "source").select("doc_id", pick(_KINDS).alias("kind"), pick(_MODES).alias("mode"), F.concat(F.lit("f"), F.col("doc_id")).alias("name"), "source")
    parent = F.when(F.col("doc_id") % 3 == 0, "class_decl").otherwise("translation_unit")
    text = instructions.instruction(F.col("kind"), F.col("name"), parent, F.col("source"), F.col("mode"), (F.col("doc_id") % 7).cast("string"), F.col("doc_id").cast("string"))
    return rows.select("doc_id", "kind", "mode", text.alias("instruction"))


_SIG = """WITH e AS (SELECT p_partkey, p_partkey % 4 AS k, p_partkey % 2 = 0 AS c, p_partkey % 3 = 0 AS s, p_partkey % 5 = 0 AS n, p_partkey % 11 = 0 AS pv, p_brand AS b, 'f' || p_size AS nm,
    '(int' || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ' a' END || ', char b = ' || p_size || ')' AS args FROM part),
    m AS (SELECT *, list_filter([CASE WHEN s THEN 'static' END, CASE WHEN pv THEN 'virtual' END, CASE WHEN c THEN 'const' END, CASE WHEN n THEN 'noexcept' END], lambda x: x IS NOT NULL) AS marks FROM e)
    SELECT p_partkey, array_to_string(list_filter(list_concat(CASE WHEN pv OR len(marks) = 0 THEN [] ELSE marks[1:len(marks) - 1] END,
    [CASE WHEN k < 2 THEN 'void' END, CASE k WHEN 0 THEN nm || args WHEN 1 THEN b || '::' || nm || args WHEN 2 THEN b || '::' || nm || args ELSE b || '::~' || nm || '()' END,
    CASE WHEN k < 2 AND c THEN 'const' END, CASE WHEN n THEN 'noexcept' END, CASE WHEN k <> 2 AND pv THEN '= 0' END]), lambda x: x IS NOT NULL), ' ') AS signature FROM m"""


@query(_SIG)
def signature_render(spark, sf_dir):
    k = F.col("p_partkey")
    every = lambda n, name: (k % n == 0).alias(name)
    arg = lambda kind, name, default: F.struct(F.lit(kind).alias("type"), name.alias("name"), default.alias("default_value"))
    args = F.array(arg("int", F.when(k % 6 == 0, "").otherwise("a"), F.lit(None).cast("string")), arg("char", F.lit("b"), F.col("p_size").cast("string")))
    sig = F.struct(
        F.concat(F.lit("f"), F.col("p_size")).alias("name"),
        F.lit("void").alias("return_type"),
        args.alias("parameters"),
        F.struct(every(2, "is_const"), every(3, "is_static"), every(11, "is_virtual"), every(11, "is_pure_virtual"), every(5, "is_noexcept")).alias("qualifiers"),
    )
    kind = F.element_at(F.array(*map(F.lit, ("function_decl", "cxx_method", "constructor", "destructor"))), (k % 4 + 1).cast("int"))
    rows = _t(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").select("p_partkey", kind.alias("kind"), "p_brand", sig.alias("sig"))
    return rows.select("p_partkey", instructions.signature(F.col("kind"), F.col("p_brand"), F.col("sig")).alias("signature"))


@query(
    """SELECT 'C' || o_orderkey AS name, 0 AS ord, 'Implement class with name C' || o_orderkey AS input, o_orderpriority AS output FROM orders
    UNION ALL SELECT 'C' || l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER), 'Implement method of class C' || l_orderkey || ' with name m' || l_partkey, l_linestatus FROM lineitem SEMI JOIN orders ON o_orderkey = l_orderkey"""
)
def lora_explode(spark, sf_dir):
    parents = _t(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    items = _t(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus")
    items = items.select(F.col("l_orderkey").alias("o_orderkey"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.struct(F.concat(F.lit("m"), F.col("l_partkey")).alias("name"), F.col("l_linestatus").alias("code")).alias("m"))
    nested = entities.attach(parents, items, "o_orderkey", F.col("m"), "place").where("o_orderpriority is not null")
    return instructions.nested_pairs(nested.select(F.concat(F.lit("C"), F.col("o_orderkey")).alias("name"), F.col("o_orderpriority").alias("declaration"), F.col("children").alias("methods")))


@query(
    """SELECT conv_id, '[' || string_agg('{"role":"' || role || '","n":' || length(text) || '}', ',' ORDER BY turn, role, text) || ']' AS messages FROM conversations GROUP BY conv_id"""
)
def chat_messages(spark, sf_dir):
    rows = _t(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return grouped.select("conv_id", F.to_json(F.transform("x", lambda m: F.struct(m["role"].alias("role"), F.length(m["text"]).alias("n")))).alias("messages"))


# Fragments -------------------------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE f(doc_id, text, n, idx, start, stop) AS (
    SELECT doc_id, text, length(text), -1, 0, 0 FROM documents
    UNION ALL SELECT doc_id, text, n, idx + 1, stop, CASE WHEN stop + 300 >= n THEN n WHEN back > 0 THEN stop + 300 - back + 1 ELSE stop + 300 END
    FROM (SELECT *, coalesce((SELECT min(p) FROM (VALUES (strpos(reverse(substr(text, stop + 1, 300)), chr(10))), (strpos(reverse(substr(text, stop + 1, 300)), ','))) v(p) WHERE p > 0), 0) AS back FROM f WHERE stop < n))
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", substr(text, start + 1, stop - start) AS code FROM f WHERE idx >= 0"""
)
def fragments_no_overlap(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text").withColumn("target", F.lit(300))
    return fragments.fragments(rows, "doc_id", "text", fragments.split_plain, "target")


def _sql_overlapping(base: str, before: str = "", points: str | None = None) -> str:
    """The overlapping split of base (id, text, target), at the places of a list ``points`` if there is one: recursive rows (id, idx, start, stop, code)."""
    back = lambda at: f"coalesce((SELECT min(p) FROM (VALUES (strpos(reverse(substr(text, nxt + 1, {at} - nxt)), chr(10))), (strpos(reverse(substr(text, nxt + 1, {at} - nxt)), ';'))) v(p) WHERE p > 0), 0)"
    more = f", {points}" if points else ""
    at = f"list_max(list_filter({points}, lambda p: p >= nxt AND p <= nxt + target))" if points else "NULL"
    return f"""RECURSIVE {before + ", " if before else ""}f(id, text, n, target, idx, start, stop, nxt{more}) AS (
    SELECT id, text, length(text), target, -1, 0, 0, 0{more} FROM ({base}) UNION ALL
    SELECT id, text, n, target, idx + 1, nxt, best, CASE WHEN e >= n THEN n WHEN p2 > 0 THEN a0 - p2 + 1 ELSE a0 END{more} FROM (SELECT *, {back("a0")} AS p2 FROM (SELECT *, greatest(best - 50, nxt + 1) AS a0 FROM (
    SELECT *, CASE WHEN e >= n THEN n WHEN pt IS NOT NULL THEN CASE WHEN pt > nxt + 50 THEN pt ELSE e END WHEN p1 > 0 AND e - p1 + 1 > nxt + 50 THEN e - p1 + 1 ELSE e END AS best FROM (SELECT *, {back("e")} AS p1, {at} AS pt FROM (SELECT *, nxt + target AS e FROM f WHERE nxt < n)))))),
    g AS (SELECT id, CAST(idx AS INTEGER) AS idx, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop, substr(text, start + 1, stop - start) AS code FROM f WHERE idx >= 0)"""


_OVERLAPPING = _sql_overlapping("SELECT doc_id AS id, text, 400 AS target FROM documents")


def _overlapping(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text").withColumn("target", F.lit(400))
    return fragments.fragments(rows, "doc_id", "text", fragments.split_overlapping, "target")


@query(f'WITH {_OVERLAPPING} SELECT id AS doc_id, idx, start, stop AS "end", code FROM g')
def fragments_overlap(spark, sf_dir):
    return _overlapping(spark, sf_dir)


@query(
    f"""WITH {_OVERLAPPING}, s AS (SELECT *, CAST(stop - start AS DOUBLE) AS size, max(idx) OVER (PARTITION BY id) AS last FROM g)
    SELECT id AS doc_id, count(*) AS n, round(avg(size), 6) AS avg_size, round(stddev_pop(size) FILTER (idx < last), 6) AS std_size, CAST(min(size) FILTER (idx < last) AS BIGINT) AS min_size,
    CAST(max(size) FILTER (idx < last) AS BIGINT) AS max_size, round(sum(size) / max(stop) * 100, 6) AS coverage FROM s GROUP BY id"""
)
def fragment_quality(spark, sf_dir):
    return fragments.quality(_overlapping(spark, sf_dir), "doc_id")


_CHUNKS = f"""WITH RECURSIVE nodes AS (SELECT doc_id, CAST([] AS BIGINT[]) AS ord, text AS t, 0 AS k FROM documents WHERE text IS NOT NULL UNION ALL
    SELECT doc_id, list_append(ord, i), part, j + 1 FROM (SELECT doc_id, ord, j, unnest(string_split(t, [chr(10) || chr(10), chr(10), ' ', ''][j + 1])) AS part, generate_subscripts(string_split(t, [chr(10) || chr(10), chr(10), ' ', ''][j + 1]), 1) AS i FROM (
    SELECT *, CASE WHEN k <= 0 AND contains(t, chr(10) || chr(10)) THEN 0 WHEN k <= 1 AND contains(t, chr(10)) THEN 1 WHEN k <= 2 AND contains(t, ' ') THEN 2 ELSE 3 END AS j FROM nodes)) WHERE length(part) > 500 AND j < 3),
    marked AS (SELECT doc_id, ord, t, [chr(10) || chr(10), chr(10), ' ', ''][1 + CASE WHEN k <= 0 AND contains(t, chr(10) || chr(10)) THEN 0 WHEN k <= 1 AND contains(t, chr(10)) THEN 1 WHEN k <= 2 AND contains(t, ' ') THEN 2 ELSE 3 END] AS mark FROM nodes),
    parts AS (SELECT doc_id, ord, mark, unnest(string_split(t, mark)) AS part, generate_subscripts(string_split(t, mark), 1) AS i FROM marked),
    fits AS (SELECT *, sum(CASE WHEN length(part) > 500 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, ord ORDER BY i) AS run FROM parts),
    sums AS (SELECT *, CAST(sum(length(part) + length(mark)) OVER (PARTITION BY doc_id, ord, run ORDER BY i) AS BIGINT) AS cum FROM fits WHERE length(part) BETWEEN 1 AND 500),
    runs AS (SELECT doc_id, list_append(ord, min(i)) AS ord, any_value(mark) AS mark, length(any_value(mark)) AS lm, count(*) AS n, list(part ORDER BY i) AS p, list(cum ORDER BY i) AS ends FROM sums GROUP BY doc_id, ord, run),
    w AS (SELECT *, CAST(1 AS BIGINT) AS f, CAST(list_max(list_filter(range(1, n + 1), lambda q: ends[q] - lm <= 500)) AS BIGINT) AS e, 0 AS nth FROM runs UNION ALL
    SELECT doc_id, ord, mark, lm, n, p, ends, g, CAST(list_max(list_filter(range(g, n + 1), lambda q: ends[q] - CASE WHEN g = 1 THEN 0 ELSE ends[g - 1] END - lm <= 500)) AS BIGINT), nth + 1 FROM (
    SELECT *, CAST(coalesce(list_min(list_filter(range(f, e + 1), lambda q: ends[e] - CASE WHEN q = 1 THEN 0 ELSE ends[q - 1] END - lm <= 50 AND ends[e + 1] - CASE WHEN q = 1 THEN 0 ELSE ends[q - 1] END - lm <= 500)), e + 1) AS BIGINT) AS g FROM w WHERE e < n)),
    c AS (SELECT doc_id, ord, nth, trim(CASE mark WHEN chr(10) || chr(10) THEN array_to_string(p[f:e], chr(10) || chr(10)) WHEN chr(10) THEN array_to_string(p[f:e], chr(10)) WHEN ' ' THEN array_to_string(p[f:e], ' ') ELSE array_to_string(p[f:e], '') END, {_BLANKS} || chr(10)) AS chunk FROM w)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, nth) - 1 AS INTEGER) AS idx, chunk FROM c WHERE chunk <> ''"""


@query(_CHUNKS)
def char_chunks(spark, sf_dir):
    return fragments.chunks(_docs(spark, sf_dir, "doc_id", "text"), "doc_id", "text")


_EMITTED = f"SELECT doc_id AS id, text, {_sql_tokens('text')} AS tokens FROM documents"
_TARGET = f"SELECT id, text, CAST(floor(512 * 0.8 * length(text) / greatest(tokens, 1)) AS INTEGER) AS target FROM ({_EMITTED}) WHERE tokens > 512"


@query(
    f"""WITH {_sql_overlapping(_TARGET)}, m AS (SELECT *, max(idx) OVER (PARTITION BY id) AS last FROM g)
    SELECT id, 'whole' AS mode, 0 AS idx, text AS output FROM ({_EMITTED}) WHERE tokens <= 512
    UNION ALL SELECT id, CASE WHEN last = 0 THEN 'whole' WHEN idx = 0 THEN 'first' WHEN idx = last THEN 'last' ELSE 'next' END, idx, code FROM m"""
)
def emitted_pairs(spark, sf_dir):
    """Whole documents within the budget, fragments of the others, with their mode."""
    rows = _docs(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").alias("code"))
    tokens = T.token_count(F.col("code"))
    target = F.floor(512 * 0.8 * F.length("code") / F.greatest(tokens, F.lit(1))).cast("int")
    pieces = fragments.fragments(rows.where(tokens > 512).withColumn("target", target), "id", "code", fragments.split_overlapping, "target")
    return instructions.emitted(rows, pieces).select("id", "mode", "idx", "output")


# Retrieval, diffs, extraction ------------------------------------------------------------------------------------

_TOP = """SELECT q.vec_id AS query_id, c.vec_id AS vec_id, round(list_sum(list_transform(list_zip(c.embedding, q.embedding), lambda x: (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)) * (CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE)))), 6) AS distance
    FROM embeddings c JOIN (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q ON c.vec_id <> q.vec_id"""
_TOP = f"SELECT query_id, vec_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank FROM ({_TOP}) QUALIFY rank <= 3"


def _found(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return retrieval.nearest(rows, rows.where("vec_id % 100 = 0"), 3)


@query(_TOP)
def vector_topk(spark, sf_dir):
    return _found(spark, sf_dir)


@query(
    f"""SELECT query_id, 'Context:' || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: which?' AS prompt FROM ({_TOP}) t JOIN documents d ON d.doc_id = t.vec_id GROUP BY query_id"""
)
def rag_prompt(spark, sf_dir):
    return retrieval.stuffed_prompt(_found(spark, sf_dir), _docs(spark, sf_dir, F.col("doc_id").alias("vec_id"), "text"), F.lit("which?"))


_DIFF = f"""WITH d AS (SELECT doc_id, source AS loc, string_split(text, chr(10)) AS l, 1 + doc_id % 6 AS line, list_transform(string_split(lang || ' doc  ' || chr(10) || ' * ' || source, chr(10)), lambda x: rtrim(x, {_BLANKS})) AS doc FROM documents),
    s AS (SELECT *, greatest(line - 3, 1) AS st, l[greatest(line - 3, 1):line + 2] AS shown FROM d)
    SELECT doc_id, 'diff --git a/' || loc || ' b/' || loc || chr(10) || 'index 0000000..0000000 100644' || chr(10) || '--- a/' || loc || chr(10) || '+++ b/' || loc || chr(10) || '@@ -' || st || ',' || len(shown) || ' +' || st || ',' || (len(shown) + len(doc)) || ' @@' || chr(10) ||
    array_to_string(list_concat(list_concat(list_transform(shown[1:line - st], lambda x: ' ' || x), list_transform(doc, lambda x: '+' || x)), list_transform(shown[line - st + 1:], lambda x: ' ' || x)), chr(10)) || chr(10) AS diff FROM s"""


@query(_DIFF)
def diff_render(spark, sf_dir):
    doc = F.concat("lang", F.lit(" doc  \n * "), "source")
    diff = diffs.insertion_diff(F.col("source"), T.lines(F.col("text")), (F.col("doc_id") % 6 + 1).cast("int"), doc)
    return _docs(spark, sf_dir, "doc_id", "source", "text", "lang").select("doc_id", diff.alias("diff"))


#: A file for each document: lines after its documentation comment; {n} is the doc_id, {s} the source.
_FILE = (
    "class C{n} {",
    "public:",
    "  explicit C{n}(int a, char b = 'x');",
    "  virtual int get() const = 0;",
    "  ~C{n}() noexcept;",
    "};",
    "struct S{n} { static int make(); };",
    "template <typename T, int N = 3> T twice(T a) { return a + N; }",
    "enum class E : int { A, B };",
    "union U { int i; float f; };",
    "typedef unsigned long size;",
    "using text = std::string;",
    "const int first = 1, second = 2;",
    "int S{n}::make() { try { return 1; } catch (...) { return 2; } }",
    "}",
    "// note {s}",
    "int f{n}(const char *s) { auto g = [](int x) { return x; }; return g(1); }",
    "auto last(int a) -> int { return a; }",
    "using namespace n{n};",
)
#: What is in it: (place, kind, name, line of the file above, text from where to where, place of the parent, return type, parameters).
_HELD = (
    (3, "class_decl", "C{n}", 0, None, 2, None, None),
    (4, "constructor", "C{n}", 2, "explicit C{n}(int a, char b = 'x');", 3, "", "int a, char b"),
    (5, "cxx_method", "get", 3, "virtual int get() const = 0;", 3, "int", ""),
    (6, "destructor", "C{n}", 4, "~C{n}() noexcept;", 3, "", ""),
    (7, "struct_decl", "S{n}", 6, "struct S{n} { static int make(); };", 2, None, None),
    (8, "cxx_method", "make", 6, "static int make();", 7, "int", ""),
    (9, "function_template", "twice", 7, "template <typename T, int N = 3> T twice(T a) { return a + N; }", 2, "T", "T a"),
    (10, "enum_decl", "E", 8, "enum class E : int { A, B };", 2, None, None),
    (11, "union_decl", "U", 9, "union U { int i; float f; };", 2, None, None),
    (12, "typedef_decl", "size", 10, "typedef unsigned long size;", 2, None, None),
    (13, "type_alias_decl", "text", 11, "using text = std::string;", 2, None, None),
    (14, "var_decl", "first", 12, "const int first = 1, second = 2;", 2, None, None),
    (15, "var_decl", "second", 12, "const int first = 1, second = 2;", 2, None, None),
    (16, "cxx_method", "make", 13, "int S{n}::make() { try { return 1; } catch (...) { return 2; } }", 7, "int", ""),
    (17, "cxx_try_stmt", None, 13, "try { return 1; }", 16, None, None),
    (18, "cxx_catch_stmt", None, 13, "catch (...) { return 2; }", 16, None, None),
    (19, "function_decl", "f{n}", 16, "int f{n}(const char *s) { auto g = [](int x) { return x; }; return g(1); }", 0, "int", "const char * s"),
    (20, "lambda_expr", None, 16, "[](int x) { return x; }", 19, None, None),
    (21, "function_decl", "last", 17, "auto last(int a) -> int { return a; }", 0, "int", "int a"),
    (22, "using_directive", None, 18, "using namespace n{n};", 0, None, None),
)


def _synthetic_files(spark, sf_dir) -> DataFrame:
    n = F.col("doc_id").cast("string")
    body = F.replace(F.replace(F.lit("\n".join(_FILE) + "\n"), F.lit("{n}"), n), F.lit("{s}"), F.col("source"))
    words = F.regexp_replace(F.col("text"), r"[*/\\]", " ")
    code = F.concat(F.lit("#include <a.h>\nnamespace n"), n, F.lit(" {\n/** "), words, F.lit(" */\n"), body)
    return _docs(spark, sf_dir, "doc_id", "text", "source").select(F.concat(F.lit("src/"), n, F.lit(".cpp")).alias("location"), code.alias("code"))


def _sql_held() -> str:
    """The expected elements, e: with places, ids and parents, computed from the file's lines."""
    put = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    body = put("\n".join(_FILE) + "\n").replace("\n", "' || chr(10) || '")
    rows = ", ".join(f"({k}, {put(t)}, {put(name)}, {line}, {put(piece)}, {up}, {put(ret)}, {put(args)})" for k, t, name, line, piece, up, ret, args in _HELD)
    fill = lambda c: f"replace({c}, '{{n}}', n)"
    return f"""d AS (SELECT CAST(doc_id AS VARCHAR) AS n, 'src/' || doc_id || '.cpp' AS location, '#include <a.h>' || chr(10) || 'namespace n' || doc_id || ' {{' || chr(10) || '/** ' || regexp_replace(text, '[*/\\\\]', ' ', 'g') || ' */' || chr(10)
    || replace(replace({body}, '{{n}}', CAST(doc_id AS VARCHAR)), '{{s}}', source) AS code FROM documents),
    f AS (SELECT n, location, code, string_split(code, chr(10)) AS l, len(string_split(code, chr(10))) - {len(_FILE)} AS top FROM d),
    h(k, type, name, below, piece, up, return_type, parameters) AS (VALUES {rows}),
    p AS (SELECT f.*, k, type, {fill("name")} AS name, top + below AS line, {fill("piece")} AS piece, up, return_type, parameters FROM f, h
    UNION ALL SELECT *, 1, 'inclusion_directive', 'a.h', 1, '#include <a.h>', 0, NULL, NULL FROM f UNION ALL SELECT *, 2, 'namespace', 'n' || n, 2, NULL, 0, NULL, NULL FROM f),
    q AS (SELECT *, CASE WHEN piece IS NULL THEN 1 ELSE strpos(l[line], piece) END AS col, CASE k WHEN 2 THEN top + 14 WHEN 3 THEN line + 5 ELSE line END AS end_line, CASE k WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE strpos(l[line], piece) + length(piece) END AS end_col,
    CASE k WHEN 2 THEN NULL WHEN 3 THEN array_to_string(l[line:line + 5], chr(10)) ELSE piece END AS text FROM p),
    i AS (SELECT *, substr(upper(type), 1, 5) AS five, substr(upper(type), 1, 5) || '-' || location || '-' || line || '-' || col AS made FROM q),
    j AS (SELECT *, five || '_' || substr(sha256(CASE WHEN name IS NULL THEN made ELSE upper(type) || '-' || location || '-' || line || '-' || col || '-' || name END), 1, 12) AS id FROM i),
    e AS (SELECT c.*, u.id AS parent_id, coalesce(u.type, 'translation_unit') AS parent_type, u.name AS parent_name, u.line AS parent_line, CASE WHEN u.k IS NULL THEN 0 WHEN u.k IN (2, 19) THEN 1 WHEN u.k = 16 THEN 3 ELSE 2 END AS level FROM j c LEFT JOIN j u ON u.location = c.location AND u.k = c.up)"""


@query(
    f"WITH {_sql_held()} SELECT location, id, parent_id, type, name, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, CAST(end_line AS INTEGER) AS end_line, CAST(end_col AS INTEGER) AS end_col, level, parent_type, parent_name, text AS code, return_type, parameters FROM e"
)
def extract_elements(spark, sf_dir):
    args = F.array_join(F.transform("signature.parameters", lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    read = ("end_line", "end_col", "level", "code", "signature")
    return extract.elements(_synthetic_files(spark, sf_dir), repeated=False, columns=read).select(
        "location", "id", "parent_id", "type", "name", "line", "col", "end_line", "end_col", "level", "parent_type", "parent_name", "code", F.col("signature.return_type").alias("return_type"), args.alias("parameters")
    )


#: A file of conditions and declarators for each document, after a comment with its text.
_BRANCHED = (
    "#if defined(A{n})",
    "int u{n}() {",
    "#else",
    "int v{n}() {",
    "#endif",
    "  return 0; }",
    "int w{n}(int a) { return a; }",
    "#ifdef X",
    "#if Y > 1",
    "namespace in{n} { int deep; }",
    "#endif",
    "#endif",
    "#if 0",
    "int broken( {",
    "#endif",
    "DECLARE(text)",
    "int (*cb{n})(int, char);",
    "struct A{n} { static int count; A{n}(); };",
    "int A{n}::count = 0;",
    "struct { int a; } v, *p;",
    "void (*signal{n}(int sig))(int);",
    "A{n}::A{n}() try : b{1} { g(); } catch (...) { h(); }",
    "[[nodiscard]] int flagged();",
    "#if B",
    "long t1(int a)",
    "#elif C",
    "int t2(int a)",
    "#else",
    "int t3(int a)",
    "#endif",
    "{ return a; }",
)
#: What is in it: (line, end line, kind, name, condition, parent, type).
_BRANCHES = (
    *((k, k, "preprocessing_directive", _BRANCHED[k - 1].split()[0][1:], "defined(X)" if k in (9, 11) else None, None, None) for k in (1, 3, 5, 8, 9, 11, 12, 13, 15, 24, 26, 28, 30)),
    (2, 6, "function_decl", "u{n}", "defined(A{n})", None, "int"),
    (4, 6, "function_decl", "v{n}", "!(defined(A{n}))", None, "int"),
    (7, 7, "function_decl", "w{n}", None, None, "int"),
    (10, 10, "namespace", "in{n}", "(defined(X)) && (Y > 1)", None, None),
    (10, 10, "var_decl", "deep", "(defined(X)) && (Y > 1)", "in{n}", "int"),
    (17, 17, "var_decl", "cb{n}", None, None, "int (*)(int, char)"),
    (18, 18, "struct_decl", "A{n}", None, None, None),
    (18, 18, "constructor", "A{n}", None, "A{n}", ""),
    (19, 19, "var_decl", "count", None, "A{n}", "int"),
    (20, 20, "struct_decl", None, None, None, None),
    (20, 20, "var_decl", "v", None, None, "struct"),
    (20, 20, "var_decl", "p", None, None, "struct *"),
    (21, 21, "function_decl", "signal{n}", None, None, "void (*)(int)"),
    (22, 22, "constructor", "A{n}", None, "A{n}", ""),
    (22, 22, "cxx_try_stmt", None, None, "A{n}", None),
    (22, 22, "cxx_catch_stmt", None, None, "A{n}", None),
    (23, 23, "function_decl", "flagged", None, None, "int"),
    (23, 23, "attribute", "nodiscard", None, "flagged", None),
    (25, 31, "function_decl", "t1", "B", None, "long"),
    (27, 31, "function_decl", "t2", "!(B) && (C)", None, "int"),
    (29, 31, "function_decl", "t3", "!(B) && !(C)", None, "int"),
)


def _sql_branches() -> str:
    put = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"""replace('{x}', '{{n}}', n)"""
    rows = " UNION ALL ".join(f"SELECT location, top + {a} AS line, top + {b} AS end_line, '{kind}' AS type, {put(name)} AS name, {put(test)} AS condition, {put(up)} AS parent_name, {put(of)} AS declared FROM f" for a, b, kind, name, test, up, of in _BRANCHES)
    return f"WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS n, 'src/' || doc_id || '.cc' AS location, len(string_split(text, chr(10))) AS top FROM documents) SELECT location, CAST(line AS INTEGER) AS line, CAST(end_line AS INTEGER) AS end_line, type, name, condition, parent_name, declared FROM ({rows})"


def _branched_files(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    words = F.regexp_replace(F.col("text"), r"[*/\\]", " ")
    code = F.concat(F.lit("/* "), words, F.lit(" */\n"), F.replace(F.lit("\n".join(_BRANCHED) + "\n"), F.lit("{n}"), n))
    return _docs(spark, sf_dir, "doc_id", "text").select(F.concat(F.lit("src/"), n, F.lit(".cc")).alias("location"), code.alias("code"))


@query(_sql_branches())
def branched_elements(spark, sf_dir):
    """All branches of nested conditions, and declarators of all forms."""
    found = extract.elements(_branched_files(spark, sf_dir), repeated=False, columns=("location", "line", "end_line", "type", "name", "condition", "parent_name", "signature.return_type", "var_type"))
    return found.select("location", "line", "end_line", "type", "name", "condition", "parent_name", F.coalesce("signature.return_type", "var_type").alias("declared"))


_RECORDS = f"""{_sql_held()}, r AS (SELECT *, list_transform(l[greatest(line - 3, 1):line - 1], lambda x: trim(x, {_BLANKS})) AS before, list_transform(l[line:line + 2], lambda x: trim(x, {_BLANKS})) AS after,
    CASE WHEN k = 3 THEN array_to_string(l[3:line - 1], chr(10)) END AS doc, CASE WHEN k = 19 THEN l[line - 1] END AS note FROM e)"""


@query(f"WITH {_RECORDS} SELECT id, type, array_to_string(before, chr(10)) AS context_before, array_to_string(after, chr(10)) AS context_after, coalesce(doc, '') AS docstrings, coalesce(note, '') AS comments FROM r")
def element_records(spark, sf_dir):
    """From source files to element records with context, comments and documentation."""
    out = records.records(_synthetic_files(spark, sf_dir), repeated=False, columns=("type",))
    return out.select("id", "type", *(F.array_join(c, "\n").alias(c) for c in ("context_before", "context_after", "docstrings", "comments")))


_VERB_ID = "['Write','Create','Develop','Provide implementation of','Produce'][1 + CAST(concat('0x', substr(md5(id), 1, 8)) AS BIGINT) % 5]"
_DOC_CLEAN = _sql_replace("doc", (r"(?m)^[*+-]+$", "''"), (r"(?m)^/\*\*|\*/", "''"), (r"(?m)^[ \t\r\n\f]*\* ?", "''"), (r"(?m)^-+$", "''"), (r"[ \t]{2,}", "' '"), (r" *\n *", "chr(10)"), (r"\n{2,}", "chr(10)"), (r"(?m)^[*+-]+$", "''"), (r"\n{2,}", "chr(10)"))
_PAIRS = f"""{_RECORDS}, w AS (SELECT *, {_sql_clean_code("text")} AS clean, nullif(trim({_DOC_CLEAN}, {_BLANKS} || chr(10)), '') AS docstring, nullif(trim(substr(note, 3), {_BLANKS}), '') AS comment,
    CASE WHEN type = 'cxx_method' THEN 'method ' || name || ' of the C++ class ' || parent_name WHEN type IN ('function_decl', 'function_template') THEN 'C++ function ' || name WHEN type IN ('constructor', 'destructor') THEN type || ' of the C++ class ' || parent_name
    WHEN type IN ('class_decl', 'struct_decl') THEN 'C++ class ' || name WHEN type = 'var_decl' THEN 'variable ' || name || ' of the project sources' ELSE 'enumeration ' || name || ' of the project sources' END AS what,
    CASE WHEN type IN ('var_decl', 'enum_decl') THEN 'Declare' ELSE {_VERB_ID} END AS verb FROM r WHERE type IN ('class_decl', 'struct_decl', 'constructor', 'destructor', 'cxx_method', 'function_template', 'function_decl', 'enum_decl', 'var_decl'))"""
_CODE_PAIRS = f"""{_PAIRS}, o AS (SELECT id, clean, verb || ' the ' || what AS p0, ' located at file: ' || location || ', line:' || line AS p1, CASE WHEN len(before) > 0 THEN chr(10) || 'Context before is: "' || array_to_string(before, chr(10)) || '"' ELSE '' END AS p2,
    coalesce(' using docstring: "' || docstring || '"', '') AS p3, coalesce(' using comments: "' || comment || '"', '') AS p4 FROM w),
    t AS (SELECT *, {", ".join(f"{_sql_tokens(f'p{i}')} AS t{i}" for i in range(5))} FROM o), s AS (SELECT *, t0 + t1 + t2 + t3 + t4 AS a FROM t),
    b AS (SELECT *, CASE WHEN a > 512 THEN a - t4 ELSE a END AS b FROM s), c AS (SELECT *, CASE WHEN b > 512 THEN b - t2 ELSE b END AS c FROM b), z AS (SELECT *, CASE WHEN c > 512 THEN c - t1 ELSE c END AS d FROM c)
    SELECT id, 'whole' AS mode, 0 AS idx, p0 || CASE WHEN c <= 512 THEN p1 ELSE '' END || CASE WHEN b <= 512 THEN p2 ELSE '' END || p3 || CASE WHEN a <= 512 THEN p4 ELSE '' END AS input, clean AS output, d > 512 AS too_long FROM z"""


@query(f"WITH {_CODE_PAIRS}")
def code_pairs(spark, sf_dir):
    """From source files to instruction and code."""
    return records.code_pairs(records.documented(records.records(_synthetic_files(spark, sf_dir), repeated=False, columns=records.PAIRS)))


@query(f"WITH {_PAIRS} SELECT id, 'Write documentation (docstring) for the ' || what || ' with code: ' || clean AS input, docstring AS output FROM w WHERE docstring IS NOT NULL")
def doc_pairs(spark, sf_dir):
    """From source files to code and documentation."""
    return records.doc_pairs(records.documented(records.records(_synthetic_files(spark, sf_dir), repeated=False, columns=records.PAIRS)))


@query(
    """SELECT doc_id, lang AS brief, 'a' AS param, source || ' text' AS description, 'bad' AS throws FROM documents"""
)
def doxygen_fields(spark, sf_dir):
    c = F.concat(F.lit("/**\n * @brief "), F.col("lang"), F.lit("\n * @param[in] a "), F.col("source"), F.lit(" text\n * @throws bad\n */"))
    x = extract.doxygen(c)
    return _docs(spark, sf_dir, "doc_id", "lang", "source").select("doc_id", x["brief"].alias("brief"), F.get(x["params"], F.lit(0))["name"].alias("param"), F.get(x["params"], F.lit(0))["description"].alias("description"), F.get(x["throws"], F.lit(0)).alias("throws"))


@query("""SELECT doc_id, 'Of ' || lang || '.' AS brief, 'More of it.' AS details, '[out]' AS direction, 'b' AS param, source || ' text' AS description, 'use ' || source AS deprecated, 'int x = ' || doc_id || ';' AS block FROM documents""")
def doxygen_tags(spark, sf_dir):
    parts = ("/**\n * Of ", "lang", ".\n * More of it.\n * @param [out] b ", "source", " text\n * @deprecated use ", "source", "\n * @code\n * int x = ", "doc_id", ";\n * @endcode\n */")
    x = extract.doxygen(F.concat(*(F.col(p) if i % 2 else F.lit(p) for i, p in enumerate(parts))))
    p = F.get(x["params"], F.lit(0))
    return _docs(spark, sf_dir, "doc_id", "lang", "source").select("doc_id", x["brief"].alias("brief"), x["details"].alias("details"), p["direction"].alias("direction"), p["name"].alias("param"), p["description"].alias("description"), x["deprecated"].alias("deprecated"), F.get(x["code_blocks"], F.lit(0)).alias("block"))


@query(
    """SELECT 'f' || doc_id AS location, 3 AS line, 1 AS col, 'Warning' AS severity, source AS message FROM documents
    UNION ALL SELECT 'f' || doc_id, 2, 10, 'Error', '''{'' is not closed' FROM documents WHERE lang = 'en'
    UNION ALL SELECT 'f' || doc_id, 2, 12, 'Error', '''}'' closes nothing' FROM documents WHERE lang = 'de'"""
)
def scanner_diagnostics(spark, sf_dir):
    body = F.when(F.col("lang") == "en", "{ ").when(F.col("lang") == "de", "{}}").otherwise("{ }")
    code = F.concat(F.lit("int a; // {\nvoid f() "), body, F.lit("\n#warning "), F.col("source"), F.lit("\n"))
    return extract.diagnostics(_docs(spark, sf_dir, "doc_id", "lang", "source").select(F.concat(F.lit("f"), F.col("doc_id")).alias("location"), code.alias("code")))


@query("SELECT CASE WHEN event_type IN ('click', 'view') THEN 'expected' ELSE 'unexpected' END AS bucket, event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def unhandled_kinds(spark, sf_dir):
    return profile.unhandled(_t(spark, sf_dir, "events", "event_type"), "event_type", ("click", "view"))


@query(f"SELECT count(*) AS n, count_if(too_long) AS too_long FROM ({_BUDGET})")
def skipped_counts(spark, sf_dir):
    return profile.flagged(prompt_budget(spark, sf_dir), "too_long")


@query(f"""SELECT doc_id AS element_id, doc_id || '_frag' || idx AS fragment_id, code, start AS start_pos, "end" AS end_pos, lang AS element_name, source AS file, n_chars AS line FROM ({ORACLE["fragments_no_overlap"]}) JOIN documents USING (doc_id)""")
def fragment_records(spark, sf_dir):
    rows = _docs(spark, sf_dir, "doc_id", "text", "lang", "source", "n_chars")
    out = fragments.fragment_records(fragments_no_overlap(spark, sf_dir), rows, "doc_id", "lang", "source", "n_chars")
    return out.select("*", "context.*").drop("context")
