"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is fitted on a bounded, documented sample of labelled rows (``train_docs_per_lang`` whole texts per
language, chosen by a hash of doc_id). Its log-probability matrix (``2**bits`` x languages) is broadcast in blocks of
``BLOCK_LANGS`` languages, one pass over the texts for each block, so any number of languages can be learned; the
n-grams of whole texts are scored in numpy, batch by batch. A prediction uses the text only.

Defined results: a null text, an empty text or one without any letter (Unicode category L) is ``und`` with score 0;
very long texts are scored whole, piece by piece; training rows with null text, null lang or null doc_id are not
learned from, repeated rows of a doc_id once per language; with no training rows, and for an empty table, everything
is ``und``. Equal posteriors go to the language that sorts first. Repeated rows are predicted each by itself. A null
doc_id is predicted like any other, its held_out is null. Other columns are ignored, or kept by ``accepted``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from loomline.llm.common import free, lean, stored

BLOCK_LANGS = 64
#: Languages up to which the sample's ids (``train_docs_per_lang`` each) are broadcast; beyond, they are joined by shuffles.
FEW_LANGS = 256
ORDERS = (1, 2, 3)
_LETTER = regex.compile(r"\p{L}")
#: Numbers gathered at once when texts are scored.
_CELLS = 1 << 21


@dataclass
class Model:
    """A block of languages; priors are those among all languages."""

    langs: list[str]
    log_prob: np.ndarray  # (buckets + 1) x languages; the last row is zero, for positions that start no n-gram
    log_prior: np.ndarray

    @property
    def characters(self) -> int:
        """Characters scored at once; a longer text is scored piece by piece, n-grams across pieces included."""
        return max(1024, _CELLS // (len(ORDERS) * max(1, len(self.langs))))


def _buckets(code: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each position (order - 1 positions fewer than characters)."""
    n = len(code) - order + 1
    h = np.full(n, order * 0x9E3779B9, np.uint64)
    for k in range(order):
        h = (h ^ code[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(7)) & np.uint64((1 << bits) - 1)


def _pieces(text: str, size: int) -> Iterator[tuple[str, int]]:
    """(piece, n): pieces of a text, the last n characters of which start no n-gram but in the next piece."""
    for at in range(0, max(len(text), 1), size):
        piece = text[at : at + size + ORDERS[-1] - 1]
        yield piece, max(0, len(piece) - size) if at + size < len(text) else 0


def _ngrams(texts: list[str], overlaps: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): the buckets of all n-grams, text after text, and where each text's begin.

    Each text has ``orders x (length + 1)`` entries; those that start no n-gram point to the extra zero row.
    """
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    table = np.full((len(code), len(ORDERS)), 1 << bits, np.int64)
    for k, order in enumerate(ORDERS):
        if len(code) >= order:
            table[: len(code) - order + 1, k] = _buckets(code, order, bits)
            for back in range(order):  # n-grams that hold or cross a text's end
                at = ends - 1 - back
                table[at[at >= 0], k] = 1 << bits
    for end, n in zip(ends, overlaps, strict=True):
        if n:
            table[end - 1 - n : end] = 1 << bits
    return table.ravel(), (ends - lengths) * len(ORDERS)


def _scored(texts: list[str], model: Model, bits: int) -> np.ndarray:
    out = np.zeros((len(texts), len(model.langs)))
    batch: list[tuple[str, int]] = []
    of: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal batch, of, size
        if batch:
            buckets, starts = _ngrams(*map(list, zip(*batch, strict=True)), bits)
            np.add.at(out, of, np.add.reduceat(model.log_prob[buckets], starts, axis=0))
        batch, of, size = [], [], 0

    for i, text in enumerate(texts):
        for piece in _pieces(text.lower(), model.characters):
            batch.append(piece)
            of.append(i)
            size += len(piece[0])
            if size >= model.characters:
                flush()
    flush()
    return out + model.log_prior


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sample(docs: DataFrame, train_docs_per_lang: int) -> DataFrame:
    """(lang, text): of each language at most that many whole texts, those of the least hashes of doc_id.

    No language's rows come together: counts tell below which hash about that many rows lie, and only those are ranked.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    counts = stored(labelled.groupBy("lang").agg(F.count("*").alias("_loomline_n")))
    few_langs = counts.count() <= FEW_LANGS  # then what is joined is so small that it can be broadcast
    small = F.broadcast if few_langs else lambda df: df
    enough = train_docs_per_lang + 8 * train_docs_per_lang**0.5 + 8  # so many are nearly always more than asked for
    # the hash as a number from 0 to 1; grouping before the rank: repeated rows of an id are one
    place = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 32)) / float(1 << 32)
    few = labelled.select("doc_id", "lang").join(small(counts), "lang").where(place * F.col("_loomline_n") < enough).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(place, "doc_id")
    chosen = few.withColumn("_loomline_nth", F.row_number().over(order)).where(F.col("_loomline_nth") <= train_docs_per_lang).select("doc_id", "lang")
    return labelled.select("doc_id", "lang", "text").join(small(chosen), ["doc_id", "lang"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, train_docs_per_lang: int = 1500, bits: int = 15, smoothing: float = 0.5) -> list[Model]:
    """The model of a bounded sample, in blocks of languages in their order."""
    texts = stored(sample(docs, train_docs_per_lang))
    sizes = {r[0]: r[1] for r in texts.groupBy("lang").count().collect()}  # one row per language

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            totals: dict[str, np.ndarray] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for piece, overlap in _pieces(text.as_py().lower(), _CELLS // 16):
                    got = np.bincount(_ngrams([piece], [overlap], bits)[0], minlength=(1 << bits) + 1)
                    totals[lang] = totals[lang] + got if lang in totals else got
                if len(totals) >= BLOCK_LANGS:
                    yield from rows(totals)
                    totals = {}
            yield from rows(totals)

    def rows(totals: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, total in totals.items():
            at = np.flatnonzero(total[:-1])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])

    counts = stored(texts.mapInArrow(lean(counted), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    langs, models = sorted(sizes), []
    for at in range(0, len(langs), BLOCK_LANGS):
        block = langs[at : at + BLOCK_LANGS]
        found = counts.where(F.col("lang").isin(block)).toPandas()  # at most 2**bits x BLOCK_LANGS rows
        place = {x: i for i, x in enumerate(block)}
        table = np.zeros((1 << bits, len(block)))
        table[found["bucket"].to_numpy(np.int64), [place[x] for x in found["lang"]]] = found["n"].to_numpy(float)
        log_prob = np.vstack([np.log((table + smoothing) / (table.sum(0) + smoothing * (1 << bits))), np.zeros(len(block))])
        models.append(Model(block, log_prob, np.log(np.array([sizes[x] for x in block]) / sum(sizes.values()))))
    return models


#: The best language, its log-probability, and the logarithm of the sum of all.
_NAMES = ["_loomline_lang", "_loomline_best", "_loomline_sum"]


def _judged(docs: DataFrame, models: list[Model], bits: int, names: list[str] = _NAMES) -> DataFrame:
    """docs with the three columns of ``_NAMES``, under names."""
    kinds = StructType(list(docs.schema.fields)).add(names[0], StringType()).add(names[1], DoubleType()).add(names[2], DoubleType())
    out, at = docs.select("*", *(F.lit(None).cast(kinds[n].dataType).alias(n) for n in names)), docs.columns.index("text")
    for model in models or [Model([], np.zeros((1, 0)), np.zeros(0))]:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def scored(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = shared.value
            for b in batches:
                texts = [x or "" for x in b.column(at).to_pylist()]
                lang = np.array(b.column(b.num_columns - 3).to_pylist(), object)
                best, total = (np.array([-np.inf if x is None else x for x in b.column(b.num_columns - k).to_pylist()], float) for k in (2, 1))
                here = np.flatnonzero([bool(_LETTER.search(x)) for x in texts])
                if len(here) and m.langs:
                    s = _scored([texts[i] for i in here], m, bits)
                    top = s.max(1)
                    total[here] = np.logaddexp(total[here], top + np.log(np.exp(s - top[:, None]).sum(1)))
                    better = top > best[here]
                    lang[here[better]] = np.array(m.langs, object)[s.argmax(1)[better]]
                    best[here] = np.maximum(best[here], top)
                found = [pa.array(lang, pa.string()), *(pa.array(x, pa.float64(), mask=np.isinf(x)) for x in (best, total))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *found], [*b.schema.names[:-3], *names])

        out = out.mapInArrow(lean(scored), kinds)
    return out


def predict(docs: DataFrame, models: list[Model], bits: int = 15) -> DataFrame:
    """doc_id, lang_pred and score of every document; only text is looked at."""
    score = F.least(F.coalesce(F.exp(F.col("_loomline_best") - F.col("_loomline_sum")), F.lit(0.0)), F.lit(1.0))
    return _judged(docs.select("doc_id", "text"), models, bits).select("doc_id", F.coalesce("_loomline_lang", F.lit("und")).alias("lang_pred"), score.alias("score"))


def accepted(docs: DataFrame, models: list[Model], bits: int = 15, wanted: tuple[str, ...] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is one of the wanted (of None: any that is known) with a score of at least ``least``; all columns stay as they are.

    ``und`` is rejected, and so is a text of which no language is as likely as all others together. A model of no languages
    rejects only what has no letter.
    """
    if not models:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = [free(docs, n) for n in _NAMES]
    sure = F.col(names[0]).isNotNull() & (F.col(names[1]) - F.col(names[2]) >= F.lit(float(np.log(least))))
    out = _judged(docs, models, bits, names).where(sure if wanted is None else sure & F.col(names[0]).isin(*wanted))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def identify(docs: DataFrame, train_docs_per_lang: int = 1500) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    out = predict(docs, fit(docs, train_docs_per_lang))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
