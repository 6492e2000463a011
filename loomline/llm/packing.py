"""Packing of documents into sequences of bounded length by a grouping genetic algorithm.

Texts become ids and a final id 0. What is longer than a sequence is cut into full pieces, the first of which
may be shorter; full pieces are sequences of their own. The other pieces are dealt at random to pods of about
``POD`` pieces. Each pod starts from best fit decreasing; where that has as few sequences as the total length allows,
nothing can be gained. The others are evolved on several islands: crossover injects whole well-filled bins of one
parent into another, removes the bins that hold an injected piece again, and puts their displaced pieces back by
best fit. Between rounds each island gets the elite of its neighbour. The best solution of a pod's islands stands.

Each pod is bounded, so work and memory per task don't grow with the input; an unlucky pod wastes part of a sequence.

Defined results: a null or empty text is one piece of length 1; a very long text gives as many pieces as it needs; ties
are broken by doc_id and piece; repeated rows are packed each by itself; a null doc_id stays null; an empty table gives
no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.bpe import tokenizer
from loomline.llm.common import lean, partitions, stored

LENGTH = 2048
POD = 4096
ISLANDS, ROUNDS, POPULATION, OFFSPRING, ELITE = 3, 2, 6, 12, 2

Bins = list[list[int]]


def best_fit(lengths: list[int], bins: Bins, items: list[int], capacity: int) -> Bins:
    """bins with items added, each where the least room is left, in the order given."""
    room = sorted((capacity - sum(lengths[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (lengths[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - lengths[i], len(bins) - 1))
        else:
            left, k = room.pop(at)
            bins[k].append(i)
            insort(room, (left - lengths[i], k))
    return bins


def fitness(lengths: list[int], bins: Bins, capacity: int) -> float:
    """Fewer bins first; among as many, the more uneven the filling, the better."""
    return -len(bins) + sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins) / (len(bins) + 1)


def crossover(lengths: list[int], mother: Bins, father: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """The mother with some of the father's best-filled bins injected."""
    filled = sorted(range(len(father)), key=lambda k: -sum(lengths[i] for i in father[k]))
    share = max(1, len(father) // 2)
    take = [father[k] for k in filled[:share] if rng.random() < 0.3] or [father[filled[0]]]
    inside = {i for b in take for i in b}
    child = [list(b) for b in take]
    displaced: list[int] = []
    for b in mother:
        if inside.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in inside]
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, child, displaced, capacity)


def mutated(lengths: list[int], bins: Bins, capacity: int, rng: np.random.Generator) -> Bins:
    """The emptiest bins and some others dissolved and fitted again, in a slightly shuffled order."""
    order = sorted(range(len(bins)), key=lambda k: sum(lengths[i] for i in bins[k]))
    gone = set(order[: max(1, len(bins) // 50)]) | {k for k in range(len(bins)) if rng.random() < 0.05}
    items = [i for k in gone for i in bins[k]]
    items.sort(key=lambda i: -lengths[i] * (1 + 0.2 * rng.random()))
    return best_fit(lengths, [list(b) for k, b in enumerate(bins) if k not in gone], items, capacity)


def lower_bound(lengths: list[int], capacity: int) -> int:
    return -(-sum(lengths) // capacity)


def evolve(lengths: list[int], elite: list[Bins], seed: int, capacity: int = LENGTH) -> list[Bins]:
    """The ELITE best solutions after OFFSPRING births, from the elite given or from nothing."""
    rng = np.random.default_rng(seed)
    decreasing = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    people = [list(map(list, e)) for e in elite] or [best_fit(lengths, [], decreasing, capacity)]
    least = lower_bound(lengths, capacity)
    if min(map(len, people)) == least:  # no solution has fewer bins
        return sorted(people, key=lambda p: -fitness(lengths, p, capacity))[:ELITE]
    while len(people) < POPULATION:
        shuffled = sorted(decreasing, key=lambda i: -lengths[i] * (1 + 0.1 * rng.random()))
        people.append(best_fit(lengths, [], shuffled, capacity))
    scored = sorted(((fitness(lengths, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    for birth in range(OFFSPRING):
        if len(scored[0][2]) == least:
            break
        a, b = rng.choice(min(4, len(scored)), 2, replace=False)
        child = mutated(lengths, crossover(lengths, scored[a][2], scored[b][2], capacity, rng), capacity, rng)
        scored.append((fitness(lengths, child, capacity), POPULATION + birth, child))
        scored.sort(key=lambda x: (-x[0], x[1]))
        scored = scored[:POPULATION]
    return [p for _, _, p in scored[:ELITE]]


def pieces(docs: DataFrame, path: str, capacity: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for b in batches:
            of: list[int] = []
            rows: list[tuple[int, int, int, int]] = []
            for i, packed in enumerate(t.packed(x.as_py() or "" for x in b.column(1))):
                ids = memoryview(packed + b"\0\0\0\0")
                n = len(ids) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                rows += [(k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
                of += [i] * (len(edges) - 1)
            cols = list(zip(*rows, strict=True)) or [()] * 4
            docs_of = b.column(0).take(pa.array(of, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs_of, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _evolved(rows: DataFrame, turn: int, capacity: int) -> DataFrame:
    """(pod, island, lengths, elite): the elite of the island and its neighbour evolved; bin numbers per solution, all solutions in one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = len(row["lengths"])
                found = [row[c][at : at + n] for c in ("elite", "migrants") if row[c] for at in range(0, len(row[c]), n)]
                out = evolve(row["lengths"], [_bins(x) for x in found], hash((row["pod"], row["island"], turn)) & 0x7FFFFFFF, capacity)
                flat = [k for p in out for k in _numbers(p, n)]
                yield pa.RecordBatch.from_arrays([pa.array([row["pod"]], pa.int64()), pa.array([row["island"]], pa.int32()), pa.array([row["lengths"]], pa.list_(pa.int32())), pa.array([flat], pa.list_(pa.int32())), pa.array([fitness(row["lengths"], out[0], capacity)], pa.float64())], ["pod", "island", "lengths", "elite", "fitness"])

    # a few small rows each stand for much work: a number given keeps them from being gathered in a few tasks
    dealt = rows.select("pod", "island", "lengths", "elite", "migrants").repartition(partitions(rows.sparkSession), "pod", "island")
    return dealt.mapInArrow(lean(run), "pod long, island int, lengths array<int>, elite array<int>, fitness double")


def _bins(numbers: list[int]) -> Bins:
    bins: Bins = [[] for _ in range(max(numbers, default=-1) + 1)]
    for i, k in enumerate(numbers):
        bins[k].append(i)
    return bins


def _numbers(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _first(pods: DataFrame, capacity: int) -> DataFrame:
    """(pod, lengths, elite, fitness, solved): best fit decreasing; solved if no solution has fewer sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pod, lengths in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                bins = best_fit(lengths, [], sorted(range(len(lengths)), key=lambda i: -lengths[i]), capacity)
                done = len(bins) == lower_bound(lengths, capacity)
                out = ([pod], [lengths], [_numbers(bins, len(lengths))], [fitness(lengths, bins, capacity)], [done])
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["pod", "lengths", "elite", "fitness", "solved"])

    return pods.mapInArrow(lean(run), "pod long, lengths array<int>, elite array<int>, fitness double, solved boolean")


def pack(cut: DataFrame, capacity: int = LENGTH, pod: int = POD) -> DataFrame:
    """The pieces with sequence_id and offset. cut is read several times: a stored table."""
    full = cut.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    items = cut.where(F.col("length") < capacity)
    pods = max(1, -(-items.count() // pod))
    row = F.monotonically_increasing_id()  # equal rows, too, are dealt to all pods
    items = items.withColumn("pod", F.pmod(F.xxhash64("doc_id", "piece", row), F.lit(pods)))
    order = Window.partitionBy("pod").orderBy(F.col("length").desc(), "doc_id", "piece")
    items = stored(items.withColumn("nth", F.row_number().over(order) - 1))
    lengths = F.transform(F.array_sort(F.collect_list(F.struct("nth", "length"))), lambda x: x["length"].cast("int"))
    first = stored(_first(items.groupBy("pod").agg(lengths.alias("lengths")).repartition(partitions(cut.sparkSession), "pod"), capacity))
    best = first.select("pod", "elite", "fitness", F.lit(-1).alias("island"))
    state = first.where(~F.col("solved")).select("pod", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", "elite", F.lit(None).cast("array<int>").alias("migrants"))
    for turn in range(ROUNDS):
        if turn:
            guests = state.select("pod", ((F.col("island") + 1) % ISLANDS).alias("island"), F.slice("elite", 1, F.size("lengths")).alias("migrants"))
            state = state.select("pod", "island", "lengths", "elite").join(guests, ["pod", "island"])
        state = stored(_evolved(state, turn, capacity))
    best = best.unionByName(state.select("pod", F.slice("elite", 1, F.size("lengths")).alias("elite"), "fitness", "island"))
    best = best.groupBy("pod").agg(F.max_by("elite", F.struct("fitness", "island")).alias("bins"))
    placed = items.join(best.select("pod", F.posexplode("bins").alias("nth", "bin")), ["pod", "nth"])
    inside = Window.partitionBy("pod", "bin").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    placed = placed.select(*cut.columns, (F.col("pod") * (1 << 20) + F.col("bin")).alias("sequence_id"), offset)
    return placed.unionByName(full)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(stored(pieces(docs, path)))
