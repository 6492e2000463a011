"""Removal of long repeated passages with suffix arrays in a logarithmic index family.

Each byte covered by a 50-byte window that also starts in a document with a smaller doc_id is removed; windows
are judged on the input. The steps, none of which holds more than one bucket or one document at a time:

1. Sampling. A window's anchor is the least fingerprint among its 16-byte strings, so equal windows have equal
   anchors. Consecutive windows with the same anchor form a segment. Of equal segments that a task sees together only
   those of the smallest doc_id are sent to buckets by anchor, packed in columns, with a fingerprint of all their
   bytes; the windows of the others go. A document whose whole text was seen in the same task with a smaller
   doc_id sends nothing: it is a copy.
2. Folding. In a bucket, equal segments become one, held by the smallest doc_id; the others are removed as a
   whole. Segments alone with their anchor are done. What is left are different segments that share an anchor.
3. Suffix arrays. The bytes of those segments are fetched, and per group of anchors enter ``SuffixLevels`` in
   batches by ascending doc_id: a batch gets the suffix array of its window starts, is merge-scanned against the
   existing levels for matches of 50 bytes, and becomes a level; levels of equal size merge, so that
   n windows lie in O(log n) levels. Comparison there is on the bytes themselves. An anchor of more than ``HOT``
   different segments, as at the ends of a passage that many documents share, is split by the next bytes: each
   segment into slices of ``SLICE`` windows, which are grouped by all the bytes that the windows of a slice have in
   common.
4. The windows found are brought to their documents, and the bytes they cover go.

Equality in steps 1 and 2 is that of 128 bits of fingerprint (the anchor's and the segment's).

Defined results: null and empty texts and those under 50 bytes lose nothing; repeated rows of one doc_id do not
match each other; where rows give one doc_id different texts, each row is matched against smaller doc_ids and the runs
found in any of them are cut from all, up to their ends; rows with a null doc_id are kept whole and match nothing; texts
are taken whole; an empty table gives no rows; other columns are ignored, or kept by ``deduplicated``, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import free, lean, partitions, stored

WINDOW = 50
GRAM = 16
#: Segments per message of step 1, windows per batch of step 3, bytes of segments handled together in step 3.
_SEND, _BATCH, _TOGETHER = 1 << 19, 1 << 17, 1 << 21
#: Different segments of an anchor that are compared without splitting it (a tenth of _TOGETHER); windows of a slice.
HOT, SLICE = 2048, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)
_COLUMNS = (("anchor", np.uint64), ("whole", np.uint64), ("doc", np.int64), ("start", np.uint32), ("count", np.uint16))
_GONE = (("doc", np.int64), ("start", np.uint32), ("count", np.uint32))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def _grams(values: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings of GRAM bytes (a power of two) at each place."""
    n = 1
    while n < GRAM:
        values = values[:-n] * _power(n) + values[n:]
        n *= 2
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


class _Powers:
    """Powers of the inverse of _ODD, as many as have been asked for."""

    def __init__(self) -> None:
        self.of = np.ones(1, np.uint64)

    def first(self, n: int) -> np.ndarray:
        step = np.uint64(pow(int(_ODD), -1, 1 << 64))
        while len(self.of) < n:
            self.of = np.concatenate([self.of, self.of * np.uint64(pow(int(step), len(self.of), 1 << 64))])
        return self.of[:n]


def segments(data: bytes, powers: _Powers) -> tuple[np.ndarray, ...]:
    """(anchor, whole, start, count) of a text's segments: runs of ``count`` windows from ``start`` with one anchor."""
    values = _BYTE[np.frombuffer(data, np.uint8)]
    anchor = _least(_grams(values), WINDOW - GRAM + 1)
    change = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
    start = np.concatenate([[0], change])
    count = np.diff(np.append(start, len(anchor)))
    if count.max() > 0xFFFF:  # long runs in parts
        parts = -(-count // 0xFFFF)
        first = np.repeat(start, parts)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        end = np.repeat(start + count, parts)
        start = first + nth * 0xFFFF
        count = np.minimum(0xFFFF, end - start)
    # sum of byte values over powers, from the start of the text; differences times the power are position-free
    p = powers.first(len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * p[:-1], dtype=np.uint64)])
    end = start + count + WINDOW - 1
    whole = (sums[end] - sums[start]) * _forward(start)
    whole = (whole ^ (whole >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + count.astype(np.uint64)
    return anchor[start], whole, start, count


def _forward(n: np.ndarray) -> np.ndarray:
    """_ODD to the powers n, by squares."""
    out = np.ones(len(n), np.uint64)
    base, left = int(_ODD), n.copy()
    while left.any():
        out = np.where(left & 1, out * np.uint64(base), out)
        base = base * base % (1 << 64)
        left >>= 1
    return out


def _sent(docs: DataFrame, buckets: int) -> DataFrame:
    """Step 1: (bucket, part, packed): segments for buckets; bucket -1: windows that go."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        powers = _Powers()
        held: list[tuple[np.ndarray, ...]] = []
        copies: list[tuple[int, int]] = []
        size = sent = 0

        def message(bucket: int, cols: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal sent
            sent += 1
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sent], pa.int64()), pa.array([b"".join(c.tobytes() for c in cols)], pa.binary())], ["bucket", "part", "packed"])

        def flush() -> Iterator[pa.RecordBatch]:
            if copies:
                doc, n = (np.array(x) for x in zip(*copies, strict=True))
                yield message(-1, [doc.astype(np.int64), np.zeros(len(doc), np.uint32), n.astype(np.uint32)])
            if not held:
                return
            cols = [np.concatenate(x).astype(t) for x, (_, t) in zip(zip(*held, strict=True), _COLUMNS, strict=True)]
            order = np.lexsort((cols[2], cols[1], cols[0]))
            anchor, whole, doc, start, count = cols = [c[order] for c in cols]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])])
            gone = doc > doc[new][np.cumsum(new) - 1]
            if gone.any():
                yield message(-1, [doc[gone], start[gone], count[gone].astype(np.uint32)])
            cols = [c[~gone] for c in cols]
            of = (cols[0] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            cols = [c[order] for c in cols]
            for k in np.flatnonzero(np.diff(cuts)):
                yield message(k, [c[cuts[k] : cuts[k + 1]] for c in cols])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if len(data) < WINDOW:
                    continue
                key = blake2b(data, digest_size=16).digest()
                first = seen.get(key)
                if first is not None and first < doc:
                    copies.append((doc, len(data) - WINDOW + 1))
                    continue
                seen[key] = doc
                anchor, whole, start, count = segments(data, powers)
                held.append((anchor, whole, np.full(len(anchor), doc), start, count))
                size += len(anchor)
                if size >= _SEND or len(seen) > _SEND:
                    yield from flush()
                    held, copies, seen, size = [], [], {}, 0
        yield from flush()

    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW))
    return rows.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(send), "bucket int, part long, packed binary")


def _unpacked(message: bytes, columns: tuple = _COLUMNS) -> list[np.ndarray]:
    n = len(message) // sum(np.dtype(t).itemsize for _, t in columns)
    out, at = [], 0
    for _, t in columns:
        out.append(np.frombuffer(message, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2 over messages sorted by bucket: (doc_id, start, count, anchor, hot); anchor is null where the windows go, else they are to be compared."""

    def out(doc: np.ndarray, start: np.ndarray, count: np.ndarray, anchor: np.ndarray | None = None, hot: np.ndarray | None = None) -> pa.RecordBatch:
        key = pa.nulls(len(doc), pa.int64()) if anchor is None else pa.array(anchor.view(np.int64))
        split = pa.nulls(len(doc), pa.bool_()) if hot is None else pa.array(hot)
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int64)), key, split], ["doc_id", "start", "count", "anchor", "hot"])

    def folded(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, whole, doc, start, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(anchor, kind="stable")
        same = anchor[order][1:] == anchor[order][:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # the rest is alone
        if not len(order):
            return
        order = order[np.lexsort((doc[order], whole[order], anchor[order]))]
        anchor, whole, doc, start, count = (x[order] for x in (anchor, whole, doc, start, count))
        new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = new_anchor | np.concatenate([[True], whole[1:] != whole[:-1]])
        holder = doc[new][np.cumsum(new) - 1]
        gone = doc > holder
        if gone.any():
            yield out(doc[gone], start[gone], count[gone])
        # of each segment the occurrences in its first document, if the anchor's segments and documents differ
        group = np.cumsum(new_anchor) - 1
        cut = np.flatnonzero(new_anchor)
        kinds = np.add.reduceat(new.astype(np.int64), cut)
        differ = (kinds > 1) & (np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut))
        ask = ~gone & differ[group]
        if ask.any():
            yield out(doc[ask], start[ask], count[ask], anchor[ask], (kinds > HOT)[group[ask]])

    held: list[list[np.ndarray]] = []
    bucket = None
    for b in batches:
        for k, message in zip(b.column(0).to_pylist(), b.column(2), strict=True):
            if k < 0:
                yield out(*_unpacked(message.as_py(), _GONE))
                continue
            if k != bucket and held:
                yield from folded(held)
                held = []
            bucket = k
            held.append(_unpacked(message.as_py()))
    if held:
        yield from folded(held)


class SuffixArray:
    """The window starts of a text, at which different windows begin, in the order of their windows."""

    def __init__(self, text: np.ndarray, starts: np.ndarray) -> None:
        self.text, self.starts = text, starts

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self) -> np.ndarray:
        """The windows' bytes and a last byte 1, because numpy's byte strings ignore zeros at the end."""
        keys = np.ones((len(self.starts), WINDOW + 1), np.uint8)
        keys[:, :WINDOW] = np.lib.stride_tricks.sliding_window_view(self.text, WINDOW)[self.starts]
        return keys.view(f"S{WINDOW + 1}").ravel()

    def merged(self, other: SuffixArray) -> SuffixArray:
        """Both in one; they have no window in common."""
        order, _ = _merge(self.windows(), other.windows())
        starts = np.concatenate([self.starts, other.starts + len(self.text)])
        return SuffixArray(np.concatenate([self.text, other.text]), starts[order])


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of two sorted lists as one, a's first among equals, and which of that order equal the one before. The stable sort merges two runs."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    both = both[order]
    return order, np.concatenate([[False], both[1:] == both[:-1]])


class SuffixLevels:
    """A logarithmic family of suffix arrays: ``add`` takes batches in ascending order of their documents."""

    def __init__(self) -> None:
        self.levels: list[SuffixArray] = []

    def add(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether each window also starts in a smaller document of this batch or in an earlier batch."""
        keys = SuffixArray(text, starts).windows()
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        cut = np.flatnonzero(new)
        least = np.minimum.reduceat(docs[order], cut)
        keys = keys[cut]
        earlier = np.zeros(len(cut), bool)
        for level in self.levels:
            place, equal = _merge(level.windows(), keys)
            earlier[place[equal] - len(level)] = True  # only the batch's can equal the one before: it is the level's
        found = np.empty(len(starts), bool)
        of = np.cumsum(new) - 1
        found[order] = earlier[of] | (docs[order] > least[of])
        array = SuffixArray(text, starts[order][cut][~earlier])
        while len(array) and self.levels and len(self.levels[-1]) < 2 * len(array):
            array = self.levels.pop().merged(array)
        if len(array):
            self.levels.append(array)
        return found


def _matched(doc: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the windows of the texts that also occur in a text of a smaller document."""
    by = np.argsort(doc, kind="stable")
    doc = doc[by]
    texts = [texts[i] for i in by]
    counts = np.array([len(t) - WINDOW + 1 for t in texts])
    total = np.cumsum(counts)
    levels = SuffixLevels()
    of_out, place_out = [], []
    at = 0
    while at < len(doc):
        end = int(np.searchsorted(total, total[at] - counts[at] + _BATCH)) + 1
        end = int(np.searchsorted(doc, doc[min(end, len(doc)) - 1], side="right"))  # batches end where a document ends
        n = counts[at:end]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(np.arange(at, end), n)
        begin = np.cumsum([0, *map(len, texts[at : end - 1])])
        found = levels.add(np.frombuffer(b"".join(texts[at:end]), np.uint8), begin[of - at] + inner, doc[of])
        of_out.append(by[of[found]])
        place_out.append(inner[found])
        at = end
    return np.concatenate(of_out), np.concatenate(place_out)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3 over (anchor, doc_id, starts, count, bytes) sorted by anchor: (doc_id, start, count) of windows that go; those without bytes do."""

    def out(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(count)], ["doc_id", "start", "count"])

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        of, place = _matched(np.array([r[1] for r in rows]), [r[4] for r in rows])
        if not len(of):
            return
        order = np.lexsort((place, of))
        of, place = of[order], place[order]
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (place[1:] > place[:-1] + 1)]))
        last = np.append(cut[1:], len(of)) - 1
        times = np.array([len(r[2]) for r in rows])[of[cut]]  # each run at each of the segment's places
        starts = np.concatenate([rows[i][2] for i in of[cut]])
        doc = np.array([r[1] for r in rows])[of[cut]]
        yield out(np.repeat(doc, times), starts + np.repeat(place[cut], times), np.repeat(place[last] - place[cut] + 1, times))

    held: list[tuple] = []
    size = 0
    for b in batches:
        gone = b.filter(pc.is_null(b.column(4)))
        if gone.num_rows:
            doc = np.repeat(gone.column(1).to_numpy(), pc.list_value_length(gone.column(2)).to_numpy())
            count = np.repeat(gone.column(3).to_numpy(), pc.list_value_length(gone.column(2)).to_numpy())
            yield out(doc, gone.column(2).flatten().to_numpy(), count)
        b = b.filter(pc.is_valid(b.column(4)))
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), map(np.array, b.column(2).to_pylist()), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
            if size >= _TOGETHER and row[0] != held[-1][0]:
                yield from compared(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield from compared(held)


def _slices(anchor: int, data: bytes) -> Iterator[tuple[int, int, int]]:
    """(key, first, count): the windows of a segment in slices, keyed by the bytes that all of a slice's windows have."""
    at = np.flatnonzero(_grams(_BYTE[np.frombuffer(data, np.uint8)]) == np.int64(anchor).view(np.uint64))
    window = np.arange(len(data) - WINDOW + 1)
    if not len(at) or at[-1] < window[-1]:  # another row of this doc_id has the segment
        return
    at = at[np.searchsorted(at, window)]  # the leftmost anchor in each window
    nth = (at - window) // SLICE
    cut = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (nth[1:] != nth[:-1])]))
    for first, count, a, q in zip(cut.tolist(), np.diff(np.append(cut, len(window))).tolist(), at[cut].tolist(), nth[cut].tolist(), strict=True):
        common = data[a - SLICE * q : a - SLICE * q + WINDOW - SLICE + 1]
        yield xxhash.xxh3_64_intdigest(common, q) - (1 << 63), first, count


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, asked) -> (anchor, doc_id, starts, count, bytes): one row for equal segments of a document; hot anchors in slices, of which those that a smaller document here has lose their bytes."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            plain: list[tuple[int, int, int, bytes]] = []
            more: dict[tuple[int, int, bytes], list[int]] = {}
            least: dict[tuple[int, bytes], int] = {}
            part = b.slice(at, 512)
            for doc, text, asked in zip(part.column(0).to_pylist(), part.column(1), part.column(2).to_pylist(), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                again = len({a["anchor"] for a in asked}) < len(asked)
                for a in asked:
                    anchor, begin, n, hot = a["anchor"], a["start"], a["count"] + WINDOW - 1, a["hot"]
                    segment = data[begin : begin + n]
                    if len(segment) < n:  # another row of this doc_id has it
                        continue
                    if hot:
                        for key, first, count in _slices(anchor, segment):
                            slice_ = segment[first : first + count + WINDOW - 1]
                            more.setdefault((key, doc, slice_), []).append(begin + first)
                            if least.setdefault((key, slice_), doc) > doc:
                                least[key, slice_] = doc
                    elif again:
                        more.setdefault((anchor, doc, segment), []).append(begin)
                    else:
                        plain.append((anchor, doc, begin, segment))
            plain_starts = [x[2] for x in plain]
            starts = pa.array([*plain_starts, *(x for found in more.values() for x in found)], pa.int64())
            edges = np.cumsum([0, *([1] * len(plain)), *map(len, more.values())], dtype=np.int32)
            bytes_ = [*(x[3] for x in plain), *(x[2] for x in more)]
            gone = [False] * len(plain) + [least.get((k, x), doc) != doc for k, doc, x in more]
            columns = [
                pa.array([*(x[0] for x in plain), *(x[0] for x in more)], pa.int64()),
                pa.array([*(x[1] for x in plain), *(x[1] for x in more)], pa.int64()),
                pa.ListArray.from_arrays(pa.array(edges), starts),
                pa.array([len(x) - WINDOW + 1 for x in bytes_], pa.int64()),
                pa.array([None if g else x for g, x in zip(gone, bytes_, strict=True)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "doc_id", "starts", "count", "bytes"])


def _runs(docs: DataFrame) -> DataFrame:
    n = partitions(docs.sparkSession)
    sent = _sent(docs, 4 * n).repartition(n, "bucket", F.when(F.col("bucket") < 0, F.xxhash64("packed"))).sortWithinPartitions("bucket")
    folded = stored(sent.mapInArrow(lean(_fold), "doc_id long, start long, count long, anchor long, hot boolean"))
    asked = folded.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "count", "hot")).alias("asked"))
    texts = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= WINDOW)).select(F.col("doc_id").cast("long"), "text")
    fetched = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(lean(_fetched), "anchor long, doc_id long, starts array<long>, count long, bytes binary")
    key = F.when(F.col("bytes").isNull(), F.xxhash64("doc_id", "anchor")).otherwise(F.col("anchor"))
    compared = stored(fetched.repartition(n, key).sortWithinPartitions("anchor").mapInArrow(lean(_compare), "doc_id long, start long, count long"))
    return folded.where("anchor is null").select("doc_id", "start", "count").unionByName(compared)


def _covered(n: int, runs: list[dict]) -> np.ndarray:
    """Which of n bytes the windows cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [min(r["start"], n) for r in runs], 1)
    np.add.at(edge, [min(r["start"] + r["count"] + WINDOW - 1, n) for r in runs], -1)
    return np.cumsum(edge[:-1]) > 0


def _with_runs(docs: DataFrame) -> DataFrame:
    """The columns of docs and, last, the document's runs."""
    runs = _runs(docs).groupBy(F.col("doc_id").alias("key")).agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("key"))
    return rows.join(runs, "key", "left").select("row.*", F.col("runs").alias(free(docs, "_loomline_runs")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                removed = spans = 0
                kept = data
                if runs.is_valid:
                    mask = _covered(len(data), runs.as_py())
                    removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                rows.append((len(data), removed, spans, sha256(kept).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = _with_runs(docs.select(F.col("doc_id").cast("long"), "text"))
    return joined.mapInArrow(lean(digested), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes removed from text; all rows and columns stay. Characters cut in two go whole."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = []
            for text, runs in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                x = text.as_py()
                if x is not None and runs.is_valid:
                    data = x.encode("utf-8", "surrogatepass")
                    x = np.frombuffer(data, np.uint8)[~_covered(len(data), runs.as_py())].tobytes().decode("utf-8", "ignore")
                texts.append(x)
            out = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield pa.RecordBatch.from_arrays(out.columns[:-1], schema=pa.schema([out.schema.field(i) for i in range(out.num_columns - 1)]))

    return _with_runs(docs).mapInArrow(lean(cut), docs.schema)
