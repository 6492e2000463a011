"""SimHash near-duplicates: blocks by pigeonhole, then the Hamming distance.

Fingerprints come from word shingles hashed with XXH64. Documents of equal fingerprints form a class, which is
represented by its smallest doc_id; only classes are compared. Each fingerprint is sent to one bucket for each
of a family of bit masks, keyed by its bits under the mask: the bits are dealt to distance + 2 blocks and each pair
of blocks is a mask; two fingerprints that differ in at most ``distance`` bits agree on two blocks at least, so no
link is lost.

Buckets are read in key order. Members of a bucket are compared with each other in blocks; what leaves is a
spanning forest of the links, never all pairs. A bucket of more than ``limit`` distinct fingerprints is not
compared but dealt again by more of the bits that its mask has left (exact again), so hot groups spread out.
Components are found by alternating large-star and small-star contraction on written tables.

``deduplicated`` is about the Jaccard similarity of sets of distinct shingles. Candidates are chained by the links of
the sets' fingerprints, as above. At a similarity near 0.8 fingerprints differ in more bits than blocks can bridge, so
equal bands of MinHash minima chain as well; they miss a pair of similarity s with a probability of
(1 - s ** rows) ** bands (0.8: 0.00015). Within a chained cluster sets are compared exactly, whatever its size, up to
the 64 bits of a shingle's hash.

Defined results: null and blank texts have fingerprint zero and are linked like any others; fewer words than a
shingle make one shingle; repeated rows with the same doc_id count once as a node; null doc_ids are left as
their own rows with null component; very long texts are hashed whole; a bit that is set in exactly half the hashes is 0, and
a component is named by its smallest doc_id; other columns are ignored, or kept by ``deduplicated``, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import free, lean, let_go, partitions, stored

#: Levels of dealing buckets again; in the last, buckets have few bits left.
DEPTH = 3
_CHUNK = 1 << 17


@dataclass(frozen=True)
class Scheme:
    shingle: int = 3
    bits: int = 64
    distance: int = 3
    limit: int = 2048  # distinct fingerprints of a bucket that are compared with each other

    @property
    def words(self) -> int:
        return self.bits // 64


@dataclass(frozen=True)
class Near:
    """Near copies: a Jaccard similarity of part / whole or more between the sets of distinct shingles."""

    shingle: int = 5
    similarity: tuple[int, int] = (4, 5)
    block: int = 256  # documents of a cluster that are compared with each other at once
    bands: int = 48
    rows: int = 8  # minima of a band
    scheme: Scheme = Scheme(shingle=5)  # of the fingerprints

    def recall(self, similarity: float) -> float:
        """The share of the pairs of that similarity that have a band in common."""
        return 1 - (1 - similarity**self.rows) ** self.bands


NEAR = Near()


def hashed_shingles(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, in the order of the text; none for a blank text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z, only ASCII space
    if not words:
        return np.zeros(0, np.uint64)
    hashed = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else [b" ".join(words)]
    return np.fromiter((hashed(s, 42) for s in shingles), np.uint64, max(1, len(words) - k + 1))


def fingerprint(text: str | None, scheme: Scheme) -> np.ndarray:
    """The fingerprint as unsigned 64-bit words, the lowest bits first."""
    return _majority(hashed_shingles(text, scheme.shingle), scheme)


def _majority(h: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The bits that are set in over half the hashes."""
    out = np.zeros(scheme.words, np.uint64)
    if not len(h):
        return out
    for w in range(scheme.words):
        if w:
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(29)
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id and the fingerprint's words f0, f1, ... as longs."""
    names = [f"f{i}" for i in range(scheme.words)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(x.as_py(), scheme) for x in b.column(1)], np.uint64).reshape(-1, scheme.words).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(f[:, i]) for i in range(scheme.words))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(made), "doc_id long, " + ", ".join(f"{n} long" for n in names))


@lru_cache(maxsize=4096)
def _masks(scheme: Scheme, path: int) -> np.ndarray:
    """The masks under a path; digits to the base of their number plus one lead from the whole to a mask."""
    base = (scheme.distance + 2) * (scheme.distance + 1) // 2 + 1
    used = _masks(scheme, path // base)[path % base - 1] if path else np.zeros(scheme.words, np.uint64)
    bits = np.unpackbits(used.astype("<u8").view(np.uint8), bitorder="little")
    left = np.flatnonzero(bits == 0)
    blocks = np.array_split(left, scheme.distance + 2)
    chosen = [np.concatenate(pair) for pair in combinations(blocks, 2)]
    out = []
    for c in chosen:
        mine = bits.copy()
        mine[c] = 1
        out.append(np.packbits(mine, bitorder="little").view("<u8"))
    return np.array(out, np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _dealt(scheme: Scheme, path: int, rep: np.ndarray, f: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, path, rep, f) of each mask under path. Equal bits have equal keys; that is all a bucket needs."""
    masks = _masks(scheme, path)
    base = len(masks) + 1
    for i, mask in enumerate(masks):
        here = path * base + i + 1
        key = np.full(len(rep), here, np.uint64)
        for w in range(scheme.words):
            key = _mixed((key * np.uint64(0x9E3779B97F4A7C15)) ^ (f[:, w] & mask[w]))
        yield key, np.full(len(rep), here, np.int64), rep, f


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component under the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (label[a], label[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compared(scheme: Scheme, starts: np.ndarray, sizes: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of rows, as (a, b) row numbers."""
    apart = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= scheme.distance
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sizes <= 48
    ends = np.repeat(starts[small] + sizes[small], sizes[small])
    rows = _ranges(starts[small], sizes[small])
    for step in range(1, int(sizes[small].max(initial=1))):
        keep = rows + step < ends
        rows, ends = rows[keep], ends[keep]
        hit = apart(f[rows], f[rows + step])
        left.append(rows[hit])
        right.append(rows[hit] + step)
    for s, n in zip(starts[~small], sizes[~small], strict=True):
        for at in range(0, n, 256):
            block = slice(s + at, s + min(at + 256, n))
            i, j = np.nonzero(apart(f[block, None], f[None, s + at : s + n]))
            # only a spanning forest leaves the block
            label = _spanning(n - at, i, j)
            moved = np.flatnonzero(label != np.arange(n - at))
            left.append(s + at + label[moved])
            right.append(s + at + moved)
    return np.concatenate(left), np.concatenate(right)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return np.arange(total) + np.repeat(starts - first, sizes)


def _scan(scheme: Scheme, batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows of (key, path, rep, f...) in key order -> links (path -1: key and rep are linked), or rows to deal again."""
    names = ["key", "path", "rep", *(f"f{i}" for i in range(scheme.words))]

    def out(key: np.ndarray, path: np.ndarray, rep: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(path), pa.array(rep), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(scheme.words))], names)

    def again(path: np.ndarray, rep: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        for p in np.unique(path):
            for x in _dealt(scheme, int(p), rep[path == p], f[path == p]):
                yield out(*x)

    held: list[tuple[np.ndarray, ...]] = []
    open_key = None  # of a bucket that is being dealt again

    def flush(rows: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        key, path, rep, f = rows
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cut, len(key)))
        large = (sizes > scheme.limit) & (not last)
        for s, n in zip(cut[large], sizes[large], strict=True):
            yield from again(path[s : s + n], rep[s : s + n], f[s : s + n])
        fit = ~large & (sizes > 1)
        a, b = _compared(scheme, cut[fit], sizes[fit], f)
        if len(a):
            label = _spanning(len(key), a, b)
            moved = np.flatnonzero(label != np.arange(len(key)))
            yield out(rep[moved].astype(np.int64), np.full(len(moved), -1, np.int64), rep[label[moved]], np.zeros((len(moved), scheme.words), np.uint64))

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        rows = (cols[0], cols[1], cols[2], np.stack([c.view(np.uint64) for c in cols[3:]], 1) if batch.num_rows else np.zeros((0, scheme.words), np.uint64))
        if not batch.num_rows:
            continue
        if open_key is not None:
            n = int((rows[0] == open_key).sum())  # keys are sorted: they come first
            yield from again(*(x[:n] for x in rows[1:]))
            rows = tuple(x[n:] for x in rows)
            if not len(rows[0]):
                continue
            open_key = None
        held.append(rows)
        if sum(len(x[0]) for x in held) >= _CHUNK:
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            at = int(np.searchsorted(rows[0], rows[0][-1]))  # the last key's bucket may go on
            yield from flush(tuple(x[:at] for x in rows))
            held = [tuple(x[at:] for x in rows)]
            if len(held[0][0]) > scheme.limit and not last:
                open_key = held[0][0][0]
                yield from again(*held[0][1:])
                held = []
    if held:
        yield from flush(tuple(np.concatenate(x) for x in zip(*held, strict=True)))


def links(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b): links between class representatives, enough to connect what is connected."""
    spark = classes.sparkSession
    names = [f"f{i}" for i in range(scheme.words)]
    schema = "key long, path long, rep long, " + ", ".join(f"{n} long" for n in names)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rep = b.column(0).to_numpy()
            f = np.stack([b.column(i + 1).to_numpy().view(np.uint64) for i in range(scheme.words)], 1) if b.num_rows else np.zeros((0, scheme.words), np.uint64)
            for key, path, r, x in _dealt(scheme, 0, rep, f):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(path), pa.array(r), *(pa.array(np.ascontiguousarray(x[:, i]).view(np.int64)) for i in range(scheme.words))], ["key", "path", "rep", *names])

    rows = classes.select("rep", *names).mapInArrow(lean(first), schema)
    found = []
    for level in range(DEPTH + 1):
        sort = rows.repartition(partitions(spark), "key").sortWithinPartitions("key")
        read = stored(sort.mapInArrow(lean(lambda it, last=level == DEPTH: _scan(scheme, it, last)), schema))
        found.append(read.where("path = -1").select(F.greatest("key", "rep").alias("a"), F.least("key", "rep").alias("b")))
        rows = read.where("path >= 0")
        if rows.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each component, for every node of edges (a, b) that is not the smallest itself."""

    def state(df: DataFrame) -> tuple[DataFrame, tuple]:
        kept = stored(df)
        return kept, tuple(kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())

    # the smallest neighbours are written, so that both sides of the joins are plain tables: then Spark itself splits
    # the rows of a node with very many neighbours
    now, seen = state(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(lower.select("a", F.col("m").alias("b")))
        after, sums = state(small.distinct())
        for x in (now, low, large, lower):
            let_go(x)
        now = after
        if sums == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = sums


def group(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, f0..., component_id of every document."""
    scheme = scheme or Scheme()
    names = [f"f{i}" for i in range(scheme.words)]
    made = stored(fingerprints(docs, scheme))
    classes = stored(made.where(F.col("doc_id").isNotNull()).groupBy(*names).agg(F.min("doc_id").alias("rep")))
    found = components(links(classes, scheme))
    labelled = classes.join(found, classes["rep"] == found["node"], "left").select(*names, F.coalesce("component", "rep").alias("component_id"))
    out = made.join(labelled, names, "left")
    return out.select("doc_id", *names, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return group(docs).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


def _forest(near: Near, ids: list[int], sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (a, b), of the pairs of documents whose sets have the similarity."""
    n, size = len(ids), np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    col = np.cumsum(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]) - 1
    shared = np.bincount(col, minlength=1) > 1
    keep = shared[col]
    col, owner = (np.cumsum(shared) - 1)[col[keep]], owner[keep]
    both = np.zeros((n, n))
    for at in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((n, int(col[hi - 1]) - at + 1), np.float32)
        m[owner[lo:hi], col[lo:hi] - at] = 1
        both += m @ m.T
    part, whole = near.similarity
    i, j = np.nonzero(np.triu((part + whole) * both >= part * (size[:, None] + size[None, :]), 1))
    label, of = _spanning(n, i, j), np.array(ids, np.int64)
    moved = np.flatnonzero(label != np.arange(n))
    return of[moved], of[label[moved]]


def _connected(rows: DataFrame, near: Near) -> DataFrame:
    """(a, b): similar pairs within the groups (cluster, i, j) of (doc_id, set), enough to connect what they connect."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []
        for b in batches:
            found = []
            for *here, doc, x in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if here != key:
                    if len(ids) > 1:
                        found.append(_forest(near, ids, sets))
                    key, ids, sets = here, [], []
                ids.append(doc)
                sets.append(np.frombuffer(x, "<u8"))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
        if len(ids) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _forest(near, ids, sets)], ["a", "b"])

    key = ["cluster", "i", "j"]
    dealt = rows.select(*key, "doc_id", "set").repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    return stored(dealt.mapInArrow(lean(compared), "a long, b long").where("a <> b"))


def similar(docs: DataFrame, members: DataFrame, near: Near) -> DataFrame:
    """(a, b): links that connect the members (doc_id, cluster) of each cluster as its similar pairs do.

    A cluster is named by its smallest doc_id. A large one is first compared in blocks, each with that document, and
    then across blocks; blocks that are as a whole in its component already need not be compared with each other.
    """
    block = near.block
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([np.unique(hashed_shingles(x.as_py(), near.shingle)).astype("<u8").tobytes() for x in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sets], ["doc_id", "cluster", "n", "set"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(members.join(sizes, "cluster"), "doc_id")
    sets = stored(texts.select("doc_id", "cluster", "n", "text").mapInArrow(lean(made), "doc_id long, cluster long, n long, set binary"))
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("long")
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), F.greatest(blocks(n), F.lit(1)))
    large = sets.where(F.col("n") > block)
    rows = sets.select("cluster", dealt(F.col("n")).alias("i"), F.lit(0).cast("long").alias("j"), "doc_id", "set")
    smallest = large.where("doc_id = cluster").select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), blocks(F.col("n")) - 1)).alias("i"), F.lit(0).cast("long").alias("j"), "doc_id", "set")
    first = _connected(rows.unionByName(smallest), near)
    if large.isEmpty():
        return first
    known = components(first)
    large = large.join(known, F.col("doc_id") == F.col("node"), "left").withColumn("rest", F.coalesce("component", "doc_id") != F.col("cluster"))
    counts = large.groupBy("cluster").agg(F.count_if("rest").alias("r"), F.count_if(~F.col("rest")).alias("s")).where("r > 0")
    r, s = F.col("r"), F.col("s")
    rows = large.join(counts, "cluster").withColumn("mine", F.when(F.col("rest"), dealt(r)).otherwise(blocks(r) + dealt(s)))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks(r) - 1 + F.when(F.col("rest"), blocks(s)).otherwise(0))))
    rows = rows.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "doc_id", "set")
    return first.unionByName(_connected(rows, near)).distinct()


def _bands(near: Near, h: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A key for each band of minima of the hashes under the multipliers."""
    least = np.full(len(by), np.iinfo(np.uint64).max)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * by).min(0), out=least)
    key = np.arange(1, near.bands + 1, dtype=np.uint64)
    for x in least.reshape(near.bands, near.rows).T:
        key = _mixed((key * np.uint64(0x9E3779B97F4A7C15)) ^ x)
    return key


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, c0, c1, bands and the fingerprint's words: equal sets of distinct shingles have equal c0 and c1; a blank text has no bands."""
    names = [f"f{i}" for i in range(near.scheme.words)]
    by = np.random.default_rng(near.bands * near.rows).integers(0, 1 << 63, near.bands * near.rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(hashed_shingles(x.as_py(), near.shingle)).astype("<u8") for x in b.column(1)]
            same = np.frombuffer(b"".join(xxhash.xxh3_128_digest(h.tobytes()) for h in sets), np.int64).reshape(-1, 2)
            bands = pa.array([_bands(near, h, by).view(np.int64) if len(h) else [] for h in sets], pa.list_(pa.int64()))
            f = np.array([_majority(h, near.scheme) for h in sets], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(same[:, 0]), pa.array(same[:, 1]), bands, *(pa.array(f[:, i]) for i in range(len(names)))], ["doc_id", "c0", "c1", "bands", *names])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(made), "doc_id long, c0 long, c1 long, bands array<long>, " + ", ".join(f"{n} long" for n in names))


def clusters(classes: DataFrame, scheme: Scheme) -> DataFrame:
    """(doc_id, cluster) of the classes (rep, bands, f0, ...) that links of fingerprints and common bands chain together, named by the smallest."""
    names = [f"f{i}" for i in range(scheme.words)]
    marked = classes.where(F.size("bands") > 0)
    alike = links(stored(marked.groupBy(*names).agg(F.min("rep").alias("rep"))), scheme)

    def starred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, pivot = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            key, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = np.concatenate([[open_key is None or key[0] != open_key], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            to = np.where(start < 0, pivot, rep[start])
            open_key, pivot = key[-1], to[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[rep != to]) for x in (rep, to)], ["a", "b"])

    every = marked.select(F.explode(F.array_append("bands", F.xxhash64(*names))).alias("key"), "rep")  # an equal fingerprint is one more key
    keys = every.repartition(partitions(classes.sparkSession), "key").sortWithinPartitions("key", "rep")
    found = stored(components(keys.mapInArrow(lean(starred), "a long, b long").unionByName(alike)))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")).unionByName(found.select(F.col("component").alias("doc_id"), F.col("component").alias("cluster")).distinct())


def deduplicated(docs: DataFrame, near: Near = NEAR) -> DataFrame:
    """docs without the documents that similar pairs connect with a smaller doc_id; all columns stay."""
    made = stored(sketches(docs, near).where(F.col("doc_id").isNotNull()))
    marks = ["bands", *(f"f{i}" for i in range(near.scheme.words))]
    classes = stored(made.groupBy("c0", "c1").agg(F.min("doc_id").alias("rep"), *(F.min_by(c, "doc_id").alias(c) for c in marks)))
    copies = made.select("doc_id", "c0", "c1").join(classes.select("c0", "c1", "rep"), ["c0", "c1"]).where("doc_id <> rep").select("doc_id")
    found = components(similar(docs, clusters(classes, near.scheme), near))
    name = free(docs, "_gone")
    gone = copies.unionByName(found.select(F.col("node").alias("doc_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")
