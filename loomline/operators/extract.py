"""C++ elements from text, by a lexical scanner.

Names, kinds, ranges, parents, parameters and qualifiers are recovered from the text alone: types are as written, not
canonical; macros are not expanded, and all branches of a condition are read, each row tagged with its ``condition``. The
scanner (``cpp``) works on one file at a time in Arrow batches; a file that it fails on has a row in ``diagnostics``, and ends a
strict run or has no elements. All that follows (ids, context, comments) is DataFrame work.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import keys
from loomline.functions.batches import PART, small
from loomline.operators.cpp import Scanner

_MASKED = re.compile(r'R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)"|/\*.*?(?:\*/|\Z)|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)

#: Prefixes of headers that don't belong to a project.
SYSTEM_PREFIXES = ("/usr/include", "/usr/lib", "/usr/local/include")

SCHEMA = (
    "type string, name string, location string, line int, col int, end_line int, end_col int, start int, stop int, level int, "
    "parent_type string, parent_name string, parent_line int, parent_col int, path array<string>, code string, is_defined boolean, "
    "signature struct<name:string,return_type:string,parameters:array<struct<name:string,type:string,default_value:string>>,"
    "qualifiers:struct<is_const:boolean,is_static:boolean,is_virtual:boolean,is_pure_virtual:boolean,is_noexcept:boolean,is_override:boolean,is_final:boolean>>, "
    "template_parameters array<struct<kind:string,name:string,default_value:string>>, fields array<struct<name:string,type:string,line:int>>, "
    "namespace string, var_type string, is_const boolean, is_static boolean, is_scoped boolean, underlying_type string, macro_args array<string>, owner string, "
    "condition string, include_kind string, aliased string, rich struct<storage_class:string,calling_convention:string,is_explicit:boolean,is_volatile:boolean,"
    "parameters:array<struct<name:string,type_kind:string,is_const:boolean,is_volatile:boolean,is_reference:boolean,is_pointer:boolean>>>"
)


def masked(code: str) -> str:
    """code with comments and literals blanked, all positions as they were."""
    return _MASKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def matching(text: str, at: int, pair: str = "{}") -> int:
    """The place of the bracket that closes the one at ``at`` in masked text, or len(text)."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == pair[0]) - (text[i] == pair[1])
        if not depth:
            return i
    return len(text)


def body_of(code: str, at: int = 0, aware: bool = True) -> str | None:
    """The balanced {...} that begins at or after ``at``; None without one. E22b: if not aware, braces in comments and literals count."""
    m = masked(code) if aware else code
    start = m.find("{", at)
    return None if start < 0 else code[start : matching(m, start) + 1]


#: What an element's id and its parent's are made of.
_PLACES = ("type", "name", "location", "line", "col", "parent_type", "parent_name", "parent_line", "parent_col")


def scan(code: str, location: str, skip: Callable[[str], bool] | None = None, signatures: bool = True) -> tuple[list[dict], str | None]:
    """The elements of a file, and what went wrong with it, if anything did; then there are none. Want of memory is not the file's: it is raised.
    Without ``signatures`` these have only name and return type, and nothing is rich."""
    collecting = gc.isenabled()
    gc.disable()  # a file's rows live until its batch leaves: looking for cycles among them finds none
    try:
        once = {(e["type"], e["name"], e["line"], e["col"]): e for e in reversed(Scanner(code, location, skip, signatures).found)}
        return list(reversed(once.values())), None
    except MemoryError:
        raise
    except Exception as error:  # noqa: BLE001 - one file must not take the others with it
        return [], f"{type(error).__name__}: {error}"
    finally:
        if collecting:
            gc.enable()


def _batch(rows: list[dict], kinds: pa.Schema) -> pa.RecordBatch:
    """Columns, one after the other: no dictionary per row is made for Arrow."""
    return pa.RecordBatch.from_arrays([pa.array([e.get(f.name) for e in rows], f.type) for f in kinds], schema=kinds)


def elements(files: DataFrame, location: str = "location", code: str = "code", skip: Callable[[str], bool] | None = None, repeated: bool = True, columns: tuple[str, ...] | None = None, beside: tuple[str, Callable[[str, list[dict]], None]] | None = None, strict: bool = False) -> DataFrame:
    """One row per element of each file (location, code), with id and parent_id, without repeated ids.

    With ``columns`` only these, and those that make ids, are built: Catalyst can't prune what a scan in Arrow makes. A field of a
    struct is asked for as ``signature.return_type``; parameters are read only if something of them is asked for.
    With ``repeated`` false each location is there once, as from a source tree: then nothing is shuffled.
    ``beside`` are further columns (DDL), and what puts them into the elements of a file, given its code and these.

    Null code has no elements; what a file leaves open ends with the file. A file that the scanner fails on ends the run if
    ``strict``, so that it can't be taken for one without elements; else it gives none (``diagnostics`` says why). A member
    that is defined outside of its class has that class as parent if the file holds it, else ``owner`` names it for ``resolved``.
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = _schema() if columns is None else StructType(list(_asked(_schema(), {*columns, *_PLACES})))
    if beside is not None:
        schema = StructType([*schema, *StructType.fromDDL(beside[0])])
    kinds = to_arrow_schema(schema)
    lists = [f.name for f in kinds if pa.types.is_list(f.type) and pa.types.is_string(f.type.value_type)]
    signatures = "rich" in schema.names or "signature" in schema.names and schema["signature"].dataType.names != ["return_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows, held = [], 0
            for place, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, failure = scan(text, place, skip, signatures) if text else ([], None)
                if strict and failure is not None:
                    raise RuntimeError(f"{place}: not read: {failure}")
                if beside is not None:
                    beside[1](text, found)
                for e in found:  # elements share a file's text; in Arrow each has its own
                    rows.append(e)
                    held += len(e.get("code") or "") + sum(len(x) for c in lists for x in e.get(c) or ())
                    if len(rows) >= 1000 or held >= PART:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
            yield _batch(rows, kinds)

    rows = files.select(location, code).mapInArrow(run, schema)
    kind = F.upper("type")
    ident = keys.element_id(kind, F.col("name"), F.col("location"), F.col("line"), F.col("col"))
    parent = F.when(F.col("parent_line").isNotNull(), keys.element_id(F.upper("parent_type"), F.col("parent_name"), F.col("location"), F.col("parent_line"), F.col("parent_col")))
    out = rows.select(ident.alias("id"), parent.alias("parent_id"), "*").drop("parent_line", "parent_col")
    return out.dropDuplicates(["id"]) if repeated else out


def _asked(schema, names: set[str]) -> Iterator:
    """The fields of a schema that are named, whole or by fields of theirs."""
    from pyspark.sql.types import StructField, StructType

    for f in schema.fields:
        inner = [g for g in f.dataType.fields if f"{f.name}.{g.name}" in names] if isinstance(f.dataType, StructType) else []
        if f.name in names:
            yield f
        elif inner:
            yield StructField(f.name, StructType(inner))


def resolved(found: DataFrame) -> DataFrame:
    """Elements, with the parents of members whose class stands in another file: the class of that qualified name, of several the first by place.

    found is read twice: a stored table. One row per class name is joined.
    """
    classes = found.where(F.col("type").isin(*keys.CLASS_LIKE) & F.col("name").isNotNull())
    name = F.array_join(F.concat("path", F.array("name")), "::")
    first = classes.groupBy(name.alias("owner")).agg(F.min_by(F.struct("id", "type"), F.struct("location", "line", "col")).alias("_class"))
    out = found.join(first, "owner", "left")
    open_ = F.col("owner").isNotNull() & F.col("parent_id").isNull() & F.col("_class").isNotNull()
    new = {"parent_id": F.when(open_, F.col("_class.id")).otherwise(F.col("parent_id")), "parent_type": F.when(open_, F.col("_class.type")).otherwise(F.col("parent_type"))}
    return out.withColumns(new).select(*found.columns)


def _schema():
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMA)


def qualified_path(path: Column) -> Column:
    """E32."""
    return F.array_join(path, "::")


def in_project(location: Column, root: str) -> Column:
    """E3, E3b."""
    outside = F.lit(False)
    for p in SYSTEM_PREFIXES:
        outside = outside | location.startswith(p)
    return ~outside & (location.startswith(root) | ~location.startswith("/"))


def problems(code: str) -> list[tuple[int, str, str]]:
    """What the scanner can't read, by place: (place, severity, message), and the file's own #error and #warning lines."""
    m = masked(code)
    out = [(d.start(1), "Error" if d[1] == "#error" else "Warning", d[2].strip()) for d in re.finditer(r"(?m)^[ \t]*(#error|#warning)\b([^\n]*)", code) if m[d.start(1)] == "#"]
    waiting: list[tuple[int, str]] = []
    for b in re.finditer(r"[()\[\]{}]", m):
        if b[0] in "([{":
            waiting.append((b.start(), b[0]))
        elif waiting and waiting[-1][1] + b[0] in ("()", "[]", "{}"):
            waiting.pop()
        else:
            out.append((b.start(), "Error", f"'{b[0]}' closes nothing"))
    out += [(at, "Error", f"'{b}' is not closed") for at, b in waiting]
    out += [(c.start(), "Fatal", "comment is not closed") for c in _MASKED.finditer(code) if c[0].startswith("/*") and (len(c[0]) < 4 or not c[0].endswith("*/"))]
    return sorted(out)


def diagnostics(files: DataFrame, errors_only: bool = False, skip: Callable[[str], bool] | None = None) -> DataFrame:
    """(location, line, col, severity, message) of what is wrong with files (location, code); with errors_only no warnings.

    A file that the scanner fails on (with that skip predicate) has one Fatal row with the reason, at its beginning. Null code has no
    diagnostics. Rows leave where their file is read: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            out: list[tuple] = []
            for place, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                failure = scan(code, place, skip)[1] if code else None
                if failure is not None:
                    out.append((place, 1, 1, "Fatal", f"not read: {failure}"))
                for at, severity, message in problems(code) if code else []:
                    out.append((place, code.count("\n", 0, at) + 1, at - code.rfind("\n", 0, at), severity, message))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["location", "line", "col", "severity", "message"])

    out = files.select("location", "code").mapInArrow(run, "location string, line int, col int, severity string, message string")
    return out.where(F.col("severity").isin("Error", "Fatal")) if errors_only else out


def find_element(rows: DataFrame, kind: str, name: str, is_defined: bool | None = None) -> DataFrame:
    """The first element of that kind and name, by place."""
    out = rows.where((F.col("type") == kind) & (F.col("name") == name))
    if is_defined is not None:
        out = out.where(F.col("is_defined") == is_defined)
    return out.orderBy("location", "line", "col").limit(1)


def code_at(files: DataFrame, places: DataFrame) -> DataFrame:
    """Places (location, line, col, end_line, end_col) with ``code``, looked up in files (location, code); null where there is no such file."""
    from loomline.functions import text as T
    from loomline.operators import lines

    rows = places.join(files.select("location", T.lines(F.col("code")).alias("_lines")), "location", "left")
    cut = lines.code_slice(F.col("_lines"), F.col("line"), F.col("col"), F.col("end_line"), F.col("end_col"))
    return rows.withColumn("code", F.when(F.col("_lines").isNotNull(), cut)).drop("_lines")


def doxygen(c: Column) -> Column:
    """struct(brief, details, returns, params, throws, see, notes, warnings, deprecated, code_blocks) from a documentation comment.

    Without a brief tag the text before the first tag gives brief, its first sentence, and details, the others. A
    parameter's direction is the bracketed word as written, or ''.
    """
    bare = F.regexp_replace(F.regexp_replace(c, r"(?md)^[ \t]*(/\*[*!]|\*/|\*|//[/!])[ \t]?", ""), r"\*/\s*$", "")
    tag = lambda name: F.transform(F.regexp_extract_all(bare, F.lit(rf"(?s)[@\\](?:{name})[ \t]+(.*?)(?=\n\s*[@\\][a-z]|\n\s*\n|$)"), 1), lambda x: F.btrim(F.regexp_replace(x, r"\s+", " ")))
    given = F.regexp_extract_all(bare, F.lit(r"[@\\]param[ \t]*(\[[A-Za-z, ]*\])?(?=[ \t]+\S)"), 1)
    split = lambda x: (F.substring_index(x, " ", 1), F.btrim(F.substring(x, F.length(F.substring_index(x, " ", 1)) + 1, F.length(x))))
    params = F.zip_with(tag(r"param(?:[ \t]*\[[A-Za-z, ]*\])?"), given, lambda x, d: F.struct(split(x)[0].alias("name"), split(x)[1].alias("description"), d.alias("direction")))
    untagged = F.btrim(F.regexp_replace(F.regexp_extract(bare, r"(?s)^(.*?)(?=[@\\][a-z]|$)", 1), r"\s+", " "))
    first = F.regexp_extract(untagged, r"^(.*?[.!?])(?= |$)", 1)
    sentence = F.when(first == "", untagged).otherwise(first)
    rest = F.btrim(F.substring(untagged, F.length(sentence) + 1, F.length(untagged)))
    blocks = F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)[@\\]code\b(.*?)[@\\]endcode"), 1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.struct(
        F.coalesce(F.get(tag("brief|short"), F.lit(0)), F.nullif(sentence, F.lit(""))).alias("brief"),
        F.coalesce(F.get(tag("details"), F.lit(0)), F.nullif(rest, F.lit(""))).alias("details"),
        F.get(tag("returns?"), F.lit(0)).alias("returns"),
        params.alias("params"),
        tag("throws?|exception").alias("throws"),
        tag("see|sa").alias("see"),
        tag("note").alias("notes"),
        tag("warning").alias("warnings"),
        F.get(tag("deprecated"), F.lit(0)).alias("deprecated"),
        blocks.alias("code_blocks"),
        c.alias("raw"),
    )
