"""Quality rules with weak supervision, in DataFrame expressions only.

Each rule votes good (1), bad (-1) or abstains (0) on a document. Vote patterns are counted over all documents
(at most ``3**rules`` rows), and expectation-maximisation over that table, written as one SQL expression,
estimates each rule's accuracy on good and on bad documents and the share of good ones. A document is kept if the
posterior probability that it is good reaches the threshold, instead of having to pass every rule.

Defined results: a null or blank text has no words, fails the base rule and is not kept; very long texts are read
whole, as one row; repeated documents get the same result each, and each counts for the accuracies; a posterior at the
threshold keeps; a null doc_id stays null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import SPACE, WORD, stored, text_or_empty

WINDOW = 8


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated_words(words: Column) -> Column:
    """Words in WINDOW-word windows that are found twice or more in the text, the first one included."""

    def dup_positions(hashes: Column) -> Column:
        entry = lambda h, i: F.struct(h.alias("h"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))
        return _let(
            F.array_sort(F.transform(hashes, entry)),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((F.get(s, i - 1)["w"] == x["w"]) | (F.get(s, i + 1)["w"] == x["w"])).alias("dup"))), lambda x: F.coalesce(x["dup"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(hashes: Column) -> Column:
        # equal windows have equal hashes: without a repeated hash there is no repeated window
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(dup_positions(hashes), covered))

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(hashes, counted)).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers that the rules look at."""
    text = text_or_empty()
    has_word = lambda x: x.rlike(WORD)
    lines = F.filter(F.split(text, "\n", -1), has_word)
    split = docs.select("doc_id", text.alias("text"), F.filter(F.split(text, SPACE, -1), lambda x: x != "").alias("words"), lines.alias("lines"))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", r"[^0-9]", "")).cast("long").alias("n_digits"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("text", F.lit(r"[^\p{L}\p{M}\p{N}\s]")).cast("long").alias("n_marks"),
        F.size(F.filter("words", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_bare_words"),
    )


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """name -> vote. A rule votes good only where it has seen enough to say so."""
    w, c = F.col("n_words"), F.col("word_chars")
    return {
        "long_enough": _vote(w < 20, w >= 40),
        "word_length": _vote((c < 2 * w) | (c > 12 * w), (c >= 3 * w) & (c <= 10 * w)),
        "few_symbols": _vote(20 * F.col("n_symbols") > c, 200 * F.col("n_symbols") <= c),
        "few_marks": _vote(6 * F.col("n_marks") > c, 10 * F.col("n_marks") <= c),
        "few_capitals": _vote(3 * F.col("n_upper") > c, 6 * F.col("n_upper") <= c),
        "few_digits": _vote(4 * F.col("n_digits") > c, 20 * F.col("n_digits") <= c),
        "words_have_letters": _vote(8 * F.col("n_bare_words") > w, 25 * F.col("n_bare_words") <= w),
        "few_repeated_lines": _vote(3 * F.col("n_dup_lines") > F.col("n_lines"), 20 * F.col("n_dup_lines") <= F.col("n_lines")),
        "few_repeated_words": _vote(10 * F.col("n_repeat_words") > 2 * w, 20 * F.col("n_repeat_words") <= w),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def fit(patterns: DataFrame, rounds: int = 40, strength: float = 10.0) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, per rule its accuracy on good and on bad documents) from rows of (votes array<int>,
    n long), one per pattern.

    ``strength`` is how many votes the starting accuracies, 0.95 on good and 0.5 on bad documents, count for. Accuracy
    on good documents stays above 0.5 and a rule never more likely says bad of good documents than of bad ones, so that good
    cannot come to mean bad. patterns has at most ``3**rules`` rows, folded into one row here.
    """
    one = patterns.agg(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("p"), F.max(F.size("votes")).alias("r"))
    one = one.where(F.size("p") > 0)
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    weight = lambda v, a: F.when(v > 0, F.log(a["good"] / (1 - a["bad"]))).when(v < 0, F.log((1 - a["good"]) / a["bad"])).otherwise(0.0)

    def posterior(votes: Column, at: Column) -> Column:
        return 1 / (1 + F.exp(-(F.log(at["share"] / (1 - at["share"])) + total(F.zip_with(votes, at["acc"], weight)))))

    def step(at: Column, _: Column) -> Column:
        q = F.transform("p", lambda x: F.struct(x["votes"].alias("v"), x["n"].alias("n"), posterior(x["votes"], at).alias("q")))

        def updated(q: Column) -> Column:
            def accuracy(_: Column, j: Column) -> Column:
                vote = lambda x: F.get(x["v"], j)
                mass = lambda sign, of_good: total(F.transform(q, lambda x: F.when(vote(x) == sign, x["n"] * (x["q"] if of_good else 1 - x["q"])).otherwise(0.0)))
                good = (mass(1, True) + 0.95 * strength) / (mass(1, True) + mass(-1, True) + strength)
                bad = (mass(-1, False) + 0.5 * strength) / (mass(1, False) + mass(-1, False) + strength)
                good = F.least(F.lit(0.999), F.greatest(F.lit(0.51), good))
                return F.struct(good.alias("good"), F.least(F.lit(0.999), F.greatest(1.01 - good, bad)).alias("bad"))

            share = total(F.transform(q, lambda x: x["n"] * x["q"])) / total(F.transform(q, lambda x: x["n"]))
            return F.struct(F.least(F.lit(0.98), F.greatest(F.lit(0.5), share)).alias("share"), F.transform(at["acc"], accuracy).alias("acc"))

        return _let(q, updated)

    start = F.struct(F.lit(0.85).alias("share"), F.array_repeat(F.struct(F.lit(0.95).alias("good"), F.lit(0.5).alias("bad")), F.col("r")).alias("acc"))
    found = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step).alias("m")).select("m.share", "m.acc").first()
    return (found[0], [(a["good"], a["bad"]) for a in found[1]]) if found else (0.85, [(0.95, 0.5)] * len(rules()))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The features of every document with base_failed, posterior and kept."""
    votes = F.array(*rules().values())
    measured = stored(features(docs))
    share, acc = fit(measured.select(votes.alias("votes")).groupBy("votes").agg(F.count("*").alias("n")))
    weight = F.log(F.lit(share / (1 - share)))
    for vote, (good, bad) in zip(rules().values(), acc, strict=True):
        weight = weight + F.when(vote > 0, math.log(good / (1 - bad))).when(vote < 0, math.log((1 - good) / bad)).otherwise(0.0)
    judged = measured.withColumn("base_failed", base_failed()).withColumn("posterior", 1 / (1 + F.exp(-weight)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
