"""Registered queries of the small operators: columns, keys, prompts, and what is written and read back.

Each applies its operator to a whole table of the driver's and has DuckDB SQL that gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import keys
from loomline.functions import text as T
from loomline.operators import entities, extract, instructions, lines, profile
from loomline.plans.catalogue import _docs, _t, query
from loomline.sources import files, tables

# Sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def written_by_type(spark, sf_dir):
    """Documents as JSON lines, a folder for each language, read back."""
    path = tables.own_folder(spark)
    files.write_by_type(_docs(spark, sf_dir, "doc_id", "lang", "source", "n_chars", "text"), path, "lang")
    return files.json_lines(spark, path, "doc_id long, source string, n_chars long, text string, lang string", tolerate=False)


@query(
    """SELECT 'code' AS kind, CASE WHEN n_chars > 1000 THEN 0 ELSE 1 END AS part, doc_id, text AS input, source AS output FROM documents WHERE n_chars IS NOT NULL
    UNION ALL SELECT 'docs', 0, doc_id, source, lang FROM documents"""
)
def written_pairs(spark, sf_dir):
    """Pairs of two parts and of one, written in order and read back with the number of their part."""
    docs, path = _docs(spark, sf_dir), tables.own_folder(spark)
    pair = lambda df, a, b: df.select("doc_id", F.col(a).alias("input"), F.col(b).alias("output"))
    files.write_pairs([pair(docs.where("n_chars > 1000"), "text", "source"), pair(docs.where("n_chars <= 1000"), "text", "source")], [pair(docs, "source", "lang")], path, "part")
    read = lambda kind: files.json_lines(spark, f"{path}/{kind}", "doc_id long, input string, output string, part int", tolerate=False).select(F.lit(kind).alias("kind"), "part", "doc_id", "input", "output")
    return read("code").unionByName(read("docs"))


@query("SELECT doc_id, source AS code, CASE WHEN lang = 'en' THEN text END AS docstring FROM documents WHERE coalesce(nullif(source, ''), CASE WHEN lang = 'en' THEN nullif(text, '') END) IS NOT NULL")
def written_records(spark, sf_dir):
    """K3: records that have content."""
    path = tables.own_folder(spark)
    files.write_records(_docs(spark, sf_dir, "doc_id", F.col("source").alias("code"), F.when(F.col("lang") == "en", F.col("text")).alias("docstring")), path)
    return files.json_lines(spark, path, "doc_id long, code string, docstring string", tolerate=False)


@query("SELECT lang || chr(9) || doc_id || chr(9) || replace(text, chr(10), '|') AS line FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND strpos(text, chr(13)) = 0")
def written_text(spark, sf_dir):
    """K4: a line of text for each document, read back as lines."""
    path = tables.own_folder(spark)
    rows = _docs(spark, sf_dir, "doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL AND instr(text, '\r') = 0")
    files.write_text(rows, F.concat("lang", F.lit("\t"), "doc_id", F.lit("\t"), F.replace("text", F.lit("\n"), F.lit("|"))), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE 'Grüße ' || doc_id END AS text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def decoded_texts(spark, sf_dir):
    """Texts as UTF-8, as UTF-16 with its mark and as Latin-1 are told apart."""
    greeting = F.concat(F.lit("Grüße "), F.col("doc_id").cast("string"))
    data = F.when(F.col("lang") == "en", F.encode("text", "UTF-8")).when(F.col("lang") == "fr", F.encode(greeting, "UTF-16")).otherwise(F.encode(greeting, "ISO-8859-1"))
    return _docs(spark, sf_dir, "doc_id", "lang", "text").where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", files.decoded(data).alias("text"))


# Keys and paths --------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, 'function_decl int f' || doc_id || '(int a' || CASE WHEN lang = 'en' THEN ' 3' ELSE '' END || ', ' || source || ' b)' AS verbose, CASE WHEN lang = 'en' THEN 'src/' || source ELSE '/else/' || source END AS place,
    lang IN ('de', 'fr') AS stopped, source LIKE '%b' OR source = 'web' AS by_suffix, doc_id % 40 AS layer FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL"""
)
def more_keys(spark, sf_dir):
    """P8b, P10, P11, P11b, P34."""
    rows = _docs(spark, sf_dir, "doc_id", "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL")
    parameter = lambda type_, name, default: F.struct(type_.alias("type"), F.lit(name).alias("name"), default.alias("default_value"))
    args = F.array(parameter(F.lit("int"), "a", F.when(F.col("lang") == "en", "3")), parameter(F.col("source"), "b", F.lit(None).cast("string")))
    path = F.concat(F.when(F.col("lang") == "en", "/p/src/").otherwise("/else/"), "source")
    return rows.select(
        "doc_id",
        keys.verbose_key(F.lit("function_decl"), F.lit("int"), F.concat(F.lit("f"), "doc_id"), args).alias("verbose"),
        keys.relative_path(path, "/p").alias("place"),
        keys.stopped(F.concat(F.lit("a/"), "lang", F.lit("/b")), ["/de/", "/fr/"]).alias("stopped"),
        keys.stopped_by_suffix(F.col("source"), ["*b", "web"]).alias("by_suffix"),
        keys.layer_number(F.concat(F.lit("model.layers."), F.col("doc_id") % 40, F.lit(".weight"))).alias("layer"),
    )


_KIND = "CASE WHEN event_type = 'click' THEN 'cxx_method' WHEN event_type = 'view' THEN 'class_decl' WHEN event_type = 'purchase' THEN 'enum_decl' ELSE event_type END"


@query(f"SELECT CASE kind WHEN 'cxx_method' THEN 'functions' WHEN 'class_decl' THEN 'classes' WHEN 'enum_decl' THEN 'declarations' END AS family, kind = 'cxx_method' AS method, count(*) AS n FROM (SELECT {_KIND} AS kind FROM events) GROUP BY ALL")
def families(spark, sf_dir):
    """P36, P37, J8."""
    kind = F.expr(_KIND)
    return _t(spark, sf_dir, "events", "event_type").groupBy(keys.family(kind).alias("family"), keys.is_method(kind).alias("method")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT 'd' || doc_id % 100 || CASE WHEN lang = 'en' THEN '/include' ELSE '/src' END AS dir, lang = 'en' AS named FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL")
def header_folders(spark, sf_dir):
    """S4, S4b."""
    place = F.concat(F.lit("d"), F.col("doc_id") % 100, F.when(F.col("lang") == "en", "/include/").otherwise("/src/"), F.col("source"), F.lit(".hpp"))
    rows = _docs(spark, sf_dir, "doc_id", "lang", "source").where("lang IS NOT NULL AND source IS NOT NULL").select(place.alias("location"))
    named = files.include_dirs(rows, True).withColumn("named", F.lit(True))
    return files.include_dirs(rows).join(named, "dir", "left").select("dir", F.coalesce("named", F.lit(False)).alias("named"))


@query("SELECT p_partkey, p_brand AS owner, 'id-' || p_partkey AS model FROM part WHERE p_brand IS NOT NULL")
def cached_models(spark, sf_dir):
    """S13."""
    names = _t(spark, sf_dir, "part", "p_partkey", "p_brand").where("p_brand IS NOT NULL")
    name = F.concat(F.lit("models--"), "p_brand", F.lit("--id-"), "p_partkey")
    found = files.installed_models(names.select(F.explode(F.array(name, F.concat(F.lit("datasets--a--"), name), F.lit("other"))).alias("name")))
    return found.select(F.substring_index("model", "-", -1).cast("long").alias("p_partkey"), "owner", "model")


# Lines -----------------------------------------------------------------------------------------------------------

_L = "string_split(text, chr(10))"


@query(
    f"""SELECT doc_id, CASE WHEN len(l) > 1 THEN substr(l[1], 3) || chr(10) || substr(l[2], 1, 4) ELSE substr(l[1], 3, 4) END AS piece, array_to_string(l[1:3], chr(10)) AS whole, length(text) > 10 AND NOT regexp_matches(text, '^[\\s/*=+#~-]*$') AS noteworthy,
    'int g' || doc_id || ';' AS looked_up FROM (SELECT *, {_L} AS l FROM documents WHERE text IS NOT NULL)"""
)
def line_slices(spark, sf_dir):
    """E23, E24, E31, E45."""
    rows = _docs(spark, sf_dir, "doc_id", "text").where("text IS NOT NULL").withColumn("l", T.lines(F.col("text")))
    many = F.size("l") > 1
    piece = F.when(many, lines.code_slice(F.col("l"), F.lit(1), F.lit(3), F.lit(2), F.lit(5))).otherwise(lines.code_slice(F.col("l"), F.lit(1), F.lit(3), F.lit(1), F.lit(7)))
    sources = rows.select(F.concat(F.lit("f"), "doc_id").alias("location"), F.concat(F.lit("// x\nint g"), "doc_id", F.lit("; int h;\n"), "text").alias("code"))
    end = F.length(F.col("doc_id").cast("string")) + 7
    places = rows.select(F.concat(F.lit("f"), "doc_id").alias("location"), F.lit(2).alias("line"), F.lit(1).alias("col"), F.lit(2).alias("end_line"), end.alias("end_col"), "doc_id")
    found = extract.code_at(sources, places).select("doc_id", F.col("code").alias("looked_up"))
    return rows.select("doc_id", piece.alias("piece"), lines.whole_lines(F.col("l"), F.lit(1), F.lit(3)).alias("whole"), T.is_noteworthy(F.col("text")).alias("noteworthy")).join(found, "doc_id")


@query("SELECT doc_id, list_concat(list_concat(['// of ' || source], list_transform(range(doc_id % 4), lambda i: '// ' || i)), ['/* last */']) AS comments FROM documents WHERE source IS NOT NULL")
def comments_above(spark, sf_dir):
    """The comments right above a line, behind the document's text."""
    more = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 4), lambda i: F.concat(F.lit("  // "), i))
    head = F.concat(F.split(F.coalesce("text", F.lit("")), "\n", -1), F.array(F.lit("int code;"), F.concat(F.lit("// of "), "source")))
    all_ = F.concat(head, F.slice(more, 1, (F.col("doc_id") % 4).cast("int")), F.array(F.lit(""), F.lit("/* last */"), F.lit("int f();")))
    return _docs(spark, sf_dir, "doc_id", "source", "text").where("source IS NOT NULL").select("doc_id", lines.preceding_comments(all_, F.size(all_)).alias("comments"))


# Prompts ---------------------------------------------------------------------------------------------------------


@query(
    """SELECT doc_id, 'Comment this:' || chr(10) || text || chr(10) || 'Thank you.' AS prompt, '[{"role":"system","content":"' || lang || '"},{"role":"user","content":"' || source || '"}]' AS messages,
    least(4000, greatest(2048, 2 * n_chars)) AS room FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL"""
)
def requests(spark, sf_dir):
    """P28, P29, P30."""
    rows = _docs(spark, sf_dir).where("text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL")
    prompt = instructions.docstring_prompt(F.col("text"), ("Comment this:", None, "Thank you."))
    messages = F.to_json(instructions.chat_messages(("system", F.col("lang")), ("user", F.col("source"))))
    return rows.select("doc_id", prompt.alias("prompt"), messages.alias("messages"), instructions.answer_budget(F.lit(4000), F.col("n_chars")).alias("room"))


@query("SELECT o_orderkey, o_orderstatus AS prompt, coalesce(n, '') AS response FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS VARCHAR) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY ALL) ON l_orderkey = o_orderkey")
def zipped_responses(spark, sf_dir):
    """J5, M5."""
    asked = _t(spark, sf_dir, "orders", "o_orderkey", F.col("o_orderstatus").alias("prompt"))
    answers = _t(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").where("l_linenumber > 2").groupBy("o_orderkey").agg(F.count("*").cast("string").alias("response"))
    return entities.zip_back(asked, answers, "o_orderkey")


@query(
    """SELECT 'C' || l_orderkey AS class_name, 'm' || l_partkey AS name, l_linestatus AS code FROM lineitem UNION ALL SELECT CAST(NULL AS VARCHAR), 'free' || p_partkey, p_brand FROM part"""
)
def all_method_rows(spark, sf_dir):
    """methods of nested classes, and those that are rows of their own."""
    items = _t(spark, sf_dir, "lineitem", "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"), F.struct(F.concat(F.lit("m"), F.col("l_partkey")).alias("name"), F.col("l_linestatus").alias("code")).alias("m"))
    nested = entities.attach(items.select("l_orderkey").distinct(), items, "l_orderkey", F.col("m"), "place").select(F.concat(F.lit("C"), F.col("l_orderkey")).alias("name"), F.col("children").alias("methods"))
    free = _t(spark, sf_dir, "part", F.lit(None).cast("string").alias("class_name"), F.concat(F.lit("free"), F.col("p_partkey")).alias("name"), F.col("p_brand").alias("code"))
    return instructions.all_methods(free, nested)


@query("SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS seconds, sum(n_chars) / count(*) AS tokens_per_second FROM documents WHERE n_chars IS NOT NULL")
def token_rates(spark, sf_dir):
    """A11."""
    return profile.rates(_docs(spark, sf_dir, "n_chars", F.lit(1).cast("long").alias("seconds")).where("n_chars IS NOT NULL"), "n_chars", "seconds")
