"""Documents as lines: context, offsets, comments, sections, slices."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from loomline.functions import text as T
from loomline.functions.batches import small


def explode_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no from 1, line)."""
    return docs.select(*keys, F.posexplode(T.lines(F.col(text))).alias("pos", "line")).select(*keys, (F.col("pos") + 1).alias("line_no"), "line")


def with_context(docs: DataFrame, *keys: str, before: int = 3, after: int = 3, text: str = "text") -> DataFrame:
    """(keys, line_no, context_before, context_after), stripped lines joined by line feeds.

    Slices of the line array: no shuffle, no window.
    """
    bare = F.transform(T.lines(F.col(text)), lambda x: T.strip(x, T.BLANK))
    split = docs.select(*keys, bare.alias("_lines"))

    def around(_: Column, i: Column) -> Column:
        least = F.greatest(i - before, F.lit(0))
        return F.struct(T.join_lines(F.slice("_lines", least + 1, i - least)).alias("b"), T.join_lines(F.slice("_lines", i + 1, after)).alias("a"))

    rows = split.select(*keys, F.posexplode(F.transform("_lines", around)).alias("pos", "x"))
    return rows.select(*keys, (F.col("pos") + 1).alias("line_no"), F.col("x.b").alias("context_before"), F.col("x.a").alias("context_after"))


def _per_document(docs: DataFrame, keys: tuple[str, ...], text: str, read: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """(keys, schema): the rows that ``read`` gives for each text. They leave where their text is: nothing is shuffled; null has none."""
    kinds = StructType([StructField(k, docs.schema[k].dataType) for k in keys] + list(StructType.fromDDL(schema)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(kinds)
        for b in small(batches):
            at, rows = [], []
            for i, x in enumerate(b.column(b.num_columns - 1).to_pylist()):
                found = list(read(x)) if x is not None else []
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows, strict=True)) or [()] * (len(out) - len(keys))
            held = [b.column(i).take(pa.array(at, pa.int64())).cast(out.field(i).type) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(c, out.field(len(keys) + i).type) for i, c in enumerate(columns))], schema=out)

    return docs.select(*keys, text).mapInArrow(run, kinds)


def offsets(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, start, length): where each line begins, in code points."""

    def read(x: str) -> Iterable[tuple]:
        start = 0
        for i, line in enumerate(x.split("\n"), 1):
            yield i, start, len(line)
            start += len(line) + 1

    return _per_document(docs, keys, text, read, "line_no int, start long, length int")


def position_to_offset(line_starts: Column, line_lengths: Column, line: Column, column: Column) -> Column:
    """The offset of (line, column), both from 1, clamped to the text."""
    n = F.least(F.greatest(line, F.lit(1)), F.size(line_starts))
    return F.element_at(line_starts, n) + F.least(F.greatest(column - 1, F.lit(0)), F.element_at(line_lengths, n))


def found_comments(text: str) -> Iterator[tuple[int, str, str]]:
    """(line_no, block or line, text): one pass over the lines, which knows whether a block is open."""
    block: list[str] | None = None
    for i, line in enumerate(text.split("\n"), 1):
        opens, closes = "/*" in line, "*/" in line
        if block is not None:
            block.append(line)
            if closes and not opens:
                yield i - len(block) + 1, "block", "\n".join(block)
                block = None
        elif opens and closes:
            yield i, "block", line
        elif opens:
            block = [line]
        elif not closes and line.lstrip(T.BLANK).startswith("//"):
            yield i, "line", line


def comments(docs: DataFrame, *keys: str, text: str = "text", keep: Column | None = None) -> DataFrame:
    """(keys, line_no, type, text, class): line comments and closed block comments, those for which ``keep`` holds.

    A line with both marks is one block; a block that stays open is lost; what stands behind code is not taken.
    """
    out = _per_document(docs, keys, text, found_comments, "line_no int, type string, text string").withColumn("class", T.classify_comment(F.col("text")))
    return out if keep is None else out.where(keep)


def sections(rows: DataFrame, *keys: str) -> DataFrame:
    """E40, W3 over (keys, line_no, line): (keys, class_name, method, doc) of a report's sections.

    A section begins with a header; a first line ``[]`` stands for no text. Of sections of the same class and method
    the last one stands.
    """
    header = r"Class[ \t]+'(\w+)'[ \t]+:[ \t]+method[ \t]+(\w+)"
    bare = T.strip(F.col("line"), T.BLANK)
    order = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line", bare).withColumn("head", F.col("line").rlike(header))
    rows = rows.withColumn("section", F.sum(F.col("head").cast("int")).over(order)).where("section > 0")
    doc = T.join_lines(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]))
    first = F.max(F.when(F.col("head"), F.col("line")))
    made = rows.groupBy(*keys, "section").agg(first.alias("head"), doc.alias("doc"))
    made = made.select(*keys, "section", F.regexp_extract("head", header, 1).alias("class_name"), F.regexp_extract("head", header, 2).alias("method"), F.when(F.substring_index("doc", "\n", 1) == "[]", "").otherwise(T.strip(F.col("doc"))).alias("doc"))
    return made.groupBy(*keys, "class_name", "method").agg(F.max_by("doc", "section").alias("doc"))


def code_slice(lines: Column, line: Column, column: Column, end_line: Column, end_column: Column, overshoot: bool = False) -> Column:
    """The text from (line, column) to before (end_line, end_column), from 1; overshoot takes one character more."""
    n = end_line - line + 1
    taken = F.slice(lines, line, n)
    last = F.substring(F.element_at(taken, -1), F.lit(1), end_column - 1 + int(overshoot))
    cut = F.when(n == 1, F.array(last)).otherwise(F.concat(F.slice(taken, 1, n - 1), F.array(last)))
    first = F.substring(cut[0], column, F.length(cut[0]))
    return T.join_lines(F.concat(F.array(first), F.slice(cut, 2, F.size(cut))))


def whole_lines(lines: Column, line: Column, end_line: Column) -> Column:
    """E24."""
    return T.join_lines(F.slice(lines, line, end_line - line + 1))


def preceding_comments(lines: Column, line: Column) -> Column:
    """The comment lines right above a line: blank lines are passed over, the first line of code ends the harvest."""
    state = F.struct(F.array().cast("array<string>").alias("got"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        bare = T.strip(x, T.BLANK)
        comment = bare.startswith("//") | bare.startswith("/*") | bare.startswith("*") | bare.endswith("*/")
        return F.struct(F.when(~s["done"] & comment, F.concat(F.array(bare), s["got"])).otherwise(s["got"]).alias("got"), (s["done"] | (~comment & (bare != ""))).alias("done"))

    return F.aggregate(F.reverse(F.slice(lines, 1, F.greatest(line - 1, F.lit(0)))), state, step, lambda s: s["got"])


#: Lines that ``comments_before`` looks at together.
BLOCK = 64


def comments_before(elements: DataFrame, found: DataFrame, key: str = "location") -> DataFrame:
    """Found comments (key, line_no, ...) joined to the element they precede: prev_end_line <= line_no < line.

    An equi-join on the file and a block of lines: an element is there once for each block that its lines before it touch, a comment
    once. So a file of any length is spread, and only what is near each other meets. Elements without prev_end_line get none.
    """
    c = found.withColumnRenamed("line_no", "comment_line").withColumn("_block", F.floor(F.col("comment_line") / BLOCK))
    near = elements.where("prev_end_line IS NOT NULL AND prev_end_line < line")
    near = near.withColumn("_block", F.explode(F.sequence(F.floor(F.col("prev_end_line") / BLOCK), F.floor((F.col("line") - 1) / BLOCK))))
    return near.join(c, [key, "_block"]).where("comment_line between prev_end_line and line - 1").drop("_block")
