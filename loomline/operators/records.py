"""From files to element records, and from records to instruction pairs: the operators of this package in sequence."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomline.functions import text as T
from loomline.functions.batches import small
from loomline.functions.keys import CLASS_LIKE, FUNCTION_LIKE
from loomline.operators import extract, fragments, instructions, lines
from loomline.sources.tables import stored


def previous_end(found: DataFrame) -> DataFrame:
    """Elements with ``prev_end_line``: where the element before ends, among those of one parent, or where the parent begins.

    Null for the first element of a file: what stands before it belongs to the file.
    """
    order = Window.partitionBy("location", "parent_id").orderBy("start", "stop")
    # a parent stands in its child's file: with the file as a key, elements without a parent are not all in one task, and the window's rows stay where they are
    parents = found.select("location", F.col("id").alias("parent_id"), F.col("line").alias("_parent_line"))
    out = found.withColumn("prev_end_line", F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))).join(parents, ["location", "parent_id"], "left")
    return out.withColumn("prev_end_line", F.coalesce("prev_end_line", "_parent_line")).select(*found.columns, "prev_end_line")


#: What the instruction pairs are made of, besides ids, places and the columns that ``records`` adds.
PAIRS = ("type", "name", "location", "line", "parent_type", "parent_name", "code")
#: What ``records`` adds to elements.
_BESIDE = "prev_end_line int, context_before array<string>, context_after array<string>, comments array<string>, docstrings array<string>"


def _identity(kind: str, name: str | None, line: int, col: int) -> tuple:
    """What ``keys.element_id`` tells elements of one file apart by."""
    return (kind.upper(), name, line, col) if name else (kind.upper()[:5], None, line, col)


def _surroundings(code: str, found: list[dict]) -> None:
    """E25, E27, E28, J6, J7b for a file's elements: where the one before ends (as ``previous_end``), context, comments and documentation."""
    if not found:
        return
    rows, comments = code.split("\n"), list(lines.found_comments(code))
    at = [c[0] for c in comments]
    here = {_identity(e["type"], e["name"], e["line"], e["col"]) for e in found}
    ends: dict[tuple | None, int] = {}
    bare = lambda part: [] if (out := [x.strip(T.BLANK) for x in part]) == [""] else out
    for e in sorted(found, key=lambda e: (e["start"], e["stop"])):
        line, up = e["line"], e.get("parent_line")
        parent = None if up is None else _identity(e["parent_type"], e["parent_name"], up, e["parent_col"])
        last = ends.get(parent, up if parent in here else None)
        ends[parent] = max(e["end_line"], ends.get(parent, e["end_line"]))
        near = [] if last is None else [c[2] for c in comments[bisect_left(at, last) : bisect_left(at, line)]]
        documents = [x.lstrip(T.BLANK).startswith(T.DOCUMENTATION) for x in near]
        e["prev_end_line"], e["context_before"], e["context_after"] = last, bare(rows[max(line - 4, 0) : line - 1]), bare(rows[line - 1 : line + 2])
        e["comments"], e["docstrings"] = ([x for x, d in zip(near, documents, strict=True) if d == which] for which in (False, True))


def records(files: DataFrame, repeated: bool = True, columns: tuple[str, ...] | None = None, strict: bool = True) -> DataFrame:
    """Files (location, code) -> elements with prev_end_line, context_before, context_after (arrays), comments and docstrings (arrays, in order).

    ``repeated``, ``columns`` and ``strict`` are those of ``extract.elements``: a file that the scanner fails on ends the run.
    All is found where a file is scanned: nothing is stored, and nothing shuffled unless locations are repeated.
    """
    return extract.elements(files, repeated=repeated, columns=columns, beside=(_BESIDE, _surroundings), strict=strict)


def documented(code: DataFrame) -> DataFrame:
    """Records with code cleaned, and docstring and comment cleaned or null."""
    clean = lambda c, f, mark: f(F.array_join(c, mark))
    # exploded from an array of one: a filter on it does not clean long documentation a second time
    rows = code.withColumns({"code": T.clean_cpp_code(F.col("code")), "comment": F.nullif(clean("comments", T.clean_comment, ""), F.lit("")), "docstring": F.explode(F.array(clean("docstrings", T.clean_docstring, "\n")))})
    return rows.withColumn("docstring", F.nullif("docstring", F.lit("")))


def prompt(rows: DataFrame, budget: int = 512) -> DataFrame:
    """P14-P17 over pieces of records (mode, idx): with ``input`` and ``too_long``; only the head (whole, first) has line and context."""
    mode, idx = F.col("mode"), F.col("idx")
    head = mode.isin("whole", "first")
    instruction = instructions.instruction(F.col("type"), F.col("name"), F.col("parent_type"), F.col("parent_name"), mode, idx.cast("string"), F.col("id"))
    quoted = lambda before, c: F.concat(F.lit(f'{before}: "'), c, F.lit('"'))
    parts = {
        "instruction": instruction,
        "location": F.when(head, F.concat(F.lit(" located at file: "), F.col("location"), F.lit(", line:"), F.col("line"))).otherwise(F.concat(F.lit(" located at file "), F.col("location"))),
        "context": F.when(head & (F.size("context_before") > 0), quoted("\nContext before is", T.join_lines(F.col("context_before")))),
        "docstring": quoted(" using docstring", F.col("docstring")),
        "comments": quoted(" using comments", F.col("comment")),
    }
    return instructions.budgeted(rows, parts, budget, into=("input", "too_long"))


def _cut(rows: DataFrame) -> DataFrame:
    """Rows (code, type, target) with ``pieces`` in the place of code: all of it where target is null, else what the kind's splitter makes of it; null for kinds without one."""
    schema = StructType([f for f in rows.schema if f.name not in ("code", "target")] + [StructField("pieces", ArrayType(StringType()))])

    def pieces(code: str | None, kind: str, target: int | None) -> list[str] | None:
        if target is None or not code:
            return [code] if code else None
        return [code[a:b] for a, b in fragments.split_statements(code, target, kind)] if kind in fragments.SPLITTERS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for b in small(batches):
            made = [pieces(*x) for x in zip(*(b.column(c).to_pylist() for c in ("code", "type", "target")), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name).cast(f.type) for f in list(kinds)[:-1]), pa.array(made, kinds.field("pieces").type)], schema=kinds)

    return rows.mapInArrow(run, schema)


def code_pairs(code: DataFrame, budget: int = 512) -> DataFrame:
    """Documented records -> (id, mode, idx, input, output, too_long): whole code within the budget, else fragments by the kind's splitter.

    Kinds without a splitter raise no error: whole they are emitted, in fragments they are not. Pieces leave where their record
    is: nothing is stored or shuffled.
    """
    kept = ("id", "type", "name", "parent_type", "parent_name", "location", "line", "context_before", "comment", "docstring", "code")
    rows = code.where(F.col("type").isin(*FUNCTION_LIKE, *CLASS_LIKE, "enum_decl", "var_decl")).select(*kept).withColumn("_tokens", T.token_count(F.col("code")))
    target = F.floor(budget * 0.8 * F.length("code") / F.greatest("_tokens", F.lit(1))).cast("int")
    cut = _cut(rows.withColumn("target", F.when(F.col("_tokens") > budget, target)).drop("_tokens"))
    pieces = cut.withColumn("n", F.size("pieces")).select("*", F.posexplode("pieces").alias("idx", "output"))
    return prompt(pieces.withColumn("mode", fragments.position_mode()), budget).select("id", "mode", "idx", "input", "output", "too_long")


def doc_pairs(code: DataFrame) -> DataFrame:
    """documented records -> (id, input, output) of those with a docstring."""
    instruction = instructions.instruction(F.col("type"), F.col("name"), F.col("parent_type"), F.col("parent_name"), F.lit("docstring"), F.lit("0"), F.col("id"))
    # a table of its own: documentation is cleaned again
    rows = stored(code.where("docstring is not null").withColumn("instruction", instruction).where("instruction is not null").select("id", "instruction", "code", "docstring"))
    return instructions.documentation_pairs(rows)
