"""A Merkle manifest of a dataset: one hash for all rows, and for each row the proof that it belongs to that hash.

A row's leaf is the hash of its columns. Within a tree (a language) leaves are numbered in order; every ``ARITY``
consecutive nodes become their hash until one is left. Leaves are numbered by one range sort over all trees, so a tree of any size is
spread over tasks. A chunk of ``ARITY ** LEVELS`` leaves is folded where it lies and leaves one unresolved node.

Unresolved nodes form a sparse forest, keyed by tree, level and index. Forests merge associatively and commutatively:
whenever the siblings of a run, whose number is known from the width of the tree, have met, they become their parent, so ``treeReduce``
may merge the forests of partitions in any order. More than ``HELD`` unresolved nodes are folded by chunks again first;
what reaches the driver is therefore bounded, whatever the input. Then proofs go down: each chunk gets the path of its node as a
row that sorts before its leaves.

Defined results: a null column is ``-``, an empty one ``0:``; a null tree comes first; null doc_ids come before others;
rows with the same tree and doc_id are ordered by their leaves, and equal rows are leaves of their own; very long texts are hashed whole;
a tree of one leaf is that leaf; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import lean, partitions, stored

ARITY = 8
#: Levels that are folded within a task; a chunk has ARITY ** LEVELS leaves.
LEVELS = 3
#: Unresolved nodes that treeReduce takes at most.
HELD = 1 << 16

_PATH = "array<struct<before:string,after:string>>"

Path = list[tuple[str, str]]


def hashed(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Forest:
    """Unresolved nodes (tree, level, index) -> hash of trees with a known number of base nodes, and the runs that were resolved."""

    def __init__(self, widths: dict[object, int] | None = None) -> None:
        self.widths = dict(widths or {})
        self.nodes: dict[tuple[object, int, int], str] = {}
        self.runs: dict[tuple[object, int, int], list[str]] = {}

    def width(self, tree: object, level: int) -> int:
        return -(-self.widths[tree] // ARITY**level)

    def add(self, tree: object, level: int, index: int, node: str) -> None:
        """The node enters; complete runs become their parents."""
        self.nodes[tree, level, index] = node
        while (width := self.width(tree, level)) > 1:
            run = index // ARITY
            keys = [(tree, level, i) for i in range(run * ARITY, min((run + 1) * ARITY, width))]
            if not all(k in self.nodes for k in keys):
                return
            self.runs[tree, level, run] = members = [self.nodes.pop(k) for k in keys]
            level, index = level + 1, run
            self.nodes[tree, level, index] = hashed("".join(members))

    def merge(self, other: Forest) -> Forest:
        self.widths |= other.widths
        self.runs |= other.runs
        for (tree, level, index), node in other.nodes.items():
            self.add(tree, level, index, node)
        return self

    def path(self, tree: object, index: int) -> Path:
        """The siblings of a base node, level by level."""
        out, level = [], 0
        while self.width(tree, level) > 1:
            members, at = self.runs[tree, level, index // ARITY], index % ARITY
            out.append(("".join(members[:at]), "".join(members[at + 1 :])))
            level, index = level + 1, index // ARITY
        return out

    def root(self, tree: object) -> str:
        return next(n for (t, level, _), n in self.nodes.items() if t == tree and self.width(tree, level) == 1)


def folded(chunk: list[str], levels: int | None) -> list[list[str]]:
    """The levels above (and with) a chunk's leaves: so many, or up to a single node."""
    out = [chunk]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        out.append([hashed("".join(out[-1][i : i + ARITY])) for i in range(0, len(out[-1]), ARITY)])
    return out


def climbed(levels: list[list[str]], index: int) -> Path:
    """The siblings of a leaf up to the top of its chunk."""
    out = []
    for nodes in levels[:-1]:
        low = index - index % ARITY
        out.append(("".join(nodes[low:index]), "".join(nodes[index + 1 : low + ARITY])))
        index //= ARITY
    return out


def refolded(leaf: str, path: Path) -> str:
    for before, after in path:
        leaf = hashed(f"{before}{leaf}{after}")
    return leaf


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """rows with ``i``, their number from 0 within their ``tree`` in that order; trees may be of any size and number."""
    spark = rows.sparkSession
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    sort = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    at = stored(sort.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # one row per partition
    sizes = {r.part: r.n for r in at.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    place = F.get(F.array(*map(F.lit, starts)) if starts else F.array(F.lit(0)), part.cast("int")) + F.col("_at").bitwiseAND((1 << 33) - 1)
    placed = at.withColumn("_at", place.cast("long"))
    first = placed.groupBy("tree").agg(F.min("_at").alias("_first")).withColumnRenamed("tree", "_tree")
    out = placed.join(first, F.col("tree").eqNullSafe(F.col("_tree")), "left")
    return out.withColumn("i", F.col("_at") - F.col("_first")).drop("_at", "_first", "_tree")


def _chunk(levels: int) -> Column:
    return F.floor(F.col("i") / F.lit(ARITY**levels)).cast("long")


def _dealt(rows: DataFrame, *then: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "tree", "chunk").sortWithinPartitions(F.asc_nulls_first("tree"), "chunk", *then)


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Runs of rows of the same tree and chunk."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, lambda r: (r["tree"], r["chunk"]))


def grown(rows: DataFrame, levels: int = LEVELS, held: int = HELD) -> tuple[DataFrame, DataFrame]:
    """Of rows (tree, i, node): (tree, root), and (tree, chunk, many, path) of each chunk: the siblings of its node up to the root."""
    spark = rows.sparkSession
    kind = rows.schema["tree"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, chunk), members in _groups(batches):
            top = folded([r["node"] for r in members], levels if chunk else None)[-1]
            yield pa.RecordBatch.from_pylist([{"tree": tree, "i": chunk, "node": top[0]}], schema=out)

    out = pa.schema([("tree", pa.int64() if kind == "bigint" else pa.string()), ("i", pa.int64()), ("node", pa.string())])
    nodes = stored(_dealt(rows.select("tree", "i", "node", _chunk(levels).alias("chunk")), "i").mapInArrow(lean(fold), f"tree {kind}, i long, node string"))
    widths = nodes.groupBy(F.col("tree").alias("_tree")).agg(F.count("*").alias("width"))
    wide = stored(nodes.join(widths, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree"))
    alone = wide.where("width = 1")
    roots = alone.select("tree", F.col("node").alias("root"))
    above = alone.select("tree", F.col("i").alias("chunk"), F.lit(False).alias("many"), F.lit(None).cast(_PATH).alias("path"))
    many = wide.where("width > 1")
    n = many.count()
    if n > held:
        more, upper = grown(many.drop("width"), levels, held)
        paths = placed(many.select("tree", "i", "node"), upper, levels)
        return roots.unionByName(more), above.unionByName(paths.select("tree", F.col("i").alias("chunk"), F.lit(True).alias("many"), "path"))
    if n:
        def fragment(part: Iterator) -> Iterator[Forest]:
            forest = Forest()
            for r in part:
                forest.widths[r.tree] = r.width
                forest.add(r.tree, 0, r.i, r.node)
            yield forest

        forest = many.rdd.mapPartitions(fragment).treeReduce(Forest.merge)
        more = spark.createDataFrame([(t, forest.root(t)) for t in forest.widths], f"tree {kind}, root string")
        paths = spark.createDataFrame([(t, i, True, forest.path(t, i)) for t, w in forest.widths.items() for i in range(w)], f"tree {kind}, chunk long, many boolean, path {_PATH}")
        roots, above = roots.unionByName(more), above.unionByName(paths)
    return roots, above


def _with_paths(rows: DataFrame, upper: DataFrame, levels: int, each: Callable[[dict, list[dict], list[list[str]]], Iterator[dict]], schema: str) -> DataFrame:
    """Each chunk's rows and its row of upper meet, upper's first; each(upper's row, rows, levels of nodes) gives what leaves."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, members in _groups(batches):
            mark = next(members)
            here = list(members)
            yield pa.RecordBatch.from_pylist(list(each(mark, here, folded([r["node"] for r in here], levels if mark["many"] else None))), schema=out)

    both = upper.withColumn("i", F.lit(-1).cast("long")).unionByName(rows.withColumn("chunk", _chunk(levels)), allowMissingColumns=True)
    return _dealt(both, "i").mapInArrow(lean(run), schema)


def placed(rows: DataFrame, upper: DataFrame, levels: int = LEVELS) -> DataFrame:
    """rows (tree, i, node) with ``path``, their siblings up to the root."""

    def each(mark: dict, here: list[dict], nodes: list[list[str]]) -> Iterator[dict]:
        above = mark["path"] or []
        for k, r in enumerate(here):
            yield {"tree": r["tree"], "i": r["i"], "node": r["node"], "path": [{"before": b, "after": a} for b, a in climbed(nodes, k)] + above}

    return _with_paths(rows, upper, levels, each, f"tree {rows.schema['tree'].dataType.simpleString()}, i long, node string, path {_PATH}")


def leaf(*columns: Column) -> Column:
    """The hash of columns: each ``-`` if null, else its length in UTF-8, ``:`` and itself."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def manifest(docs: DataFrame, tampered: Column, text: Column, levels: int = LEVELS, held: int = HELD) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row of documents.

    The proof of a row is checked for its text as it may be now: ``text`` where ``tampered`` holds.
    """
    columns = lambda t: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t)
    rows = docs.select("doc_id", F.col("lang").alias("tree"), columns(F.col("text")).alias("node"), F.when(tampered, columns(text)).alias("now"))
    leaves = stored(ranked(stored(rows), "doc_id", "node"))
    roots, upper = grown(leaves, levels, held)
    subroots = stored(ranked(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("lang"), F.col("root").alias("node")), "lang"))
    all_, top = grown(subroots, levels, held)
    root = next((r.root for r in all_.collect()), "")  # one row
    tops = placed(subroots.select("tree", "i", "node"), top, levels).select("i", F.col("path").alias("top"))
    tops = subroots.select("lang", "i", F.col("node").alias("subroot")).join(tops, "i").drop("i")
    marks = upper.join(tops, F.col("tree").eqNullSafe(F.col("lang")), "left").drop("lang")

    def each(mark: dict, here: list[dict], nodes: list[list[str]]) -> Iterator[dict]:
        above = [(s["before"], s["after"]) for s in (mark["path"] or []) + mark["top"]]
        beyond, node = "".join(b + a for b, a in above), nodes[-1][0]
        reached = refolded(node, above)
        for k, r in enumerate(here):
            path = climbed(nodes, k)
            now = refolded(r["now"] or r["node"], path)
            end = reached if now == node else refolded(now, above)
            yield {
                "doc_id": r["doc_id"], "leaf": r["node"], "subroot": mark["subroot"], "root": root, "proof_sha256": hashed("".join(b + a for b, a in path) + beyond), "folded_root": end, "verified": end == root,
            }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _with_paths(leaves, marks, levels, each, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def report(docs: DataFrame) -> DataFrame:
    """The manifest, checked against documents of which those with a crc32 of doc_id that 3 divides have lost their capital letters."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower)
