import random
import zlib

import numpy as np

from loomline.llm import language_id

WORDS = {"en": "the and of water house with being there light", "de": "und der die wasser haus mit sein dort größe", "fr": "le et la eau maison avec être où lumière"}


def rows():
    rng = random.Random(1)
    out = []
    for i in range(400):
        lang = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(3, 60))), lang, 1.0))
    return out


def test_held_out_accuracy_and_edges(spark):
    base = rows()
    extra = [(1000, None, "en", 1.0), (1001, "", "en", 1.0), (1002, "12 --- 34", "de", 1.0), (1003, "the house " * 80_000, None, 1.0), (1004, "the house", "xx", 1.0), (None, "und der", "de", 1.0)]
    df = spark.createDataFrame(base + extra, "doc_id long, text string, lang string, score double").repartition(4)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in base)
    held = [r for r in base if got[r[0]].held_out]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "en" and 0.99 < got[1003].score <= 1
    kept = language_id.accepted(df, language_id.fit(df))
    assert kept.schema == df.schema and kept.count() == df.count() - 3


def test_long_texts_score_like_short_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    m = language_id.Model(["a", "b"], np.vstack([rng.normal(size=(1 << 8, 2)), np.zeros((1, 2))]), np.zeros(2))
    texts = ["abcdefgh" * 40, "xé" * 90, "", "q"]
    whole = language_id._scored(texts, m, 8)
    monkeypatch.setattr(language_id.Model, "characters", 64)
    pieces = language_id._scored(texts, m, 8)
    assert np.allclose(whole, pieces)


def test_empty_table(spark):
    df = spark.createDataFrame(rows()[:1], "doc_id long, text string, lang string, score double").limit(0)
    assert language_id.identify(df).count() == 0


def test_like_plain_naive_bayes(spark, monkeypatch):
    """Brute force: counts in dictionaries, one text and one language after the other; also in blocks of languages."""
    import math
    import random
    from collections import Counter

    rng = random.Random(2)
    letters = {"aa": "aaabc ", "bb": "abbbc ", "cc": "abcccd ", "dd": "dde "}
    rows = [(i, "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 40))), x) for i in range(400) for x in [rng.choice(list(letters))]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "² ½ ③ Ⅷ 12", None), (1003, "ab" * 3000, "bb"), (None, "abc", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = [(t.lower(), x) for d, t, x in rows if d is not None and t is not None and x is not None and zlib.crc32(str(d).encode()) % 3 != 1]
    bits = 15
    grams = lambda t: [int(language_id._buckets(np.array(list(map(ord, t[i : i + k])), np.uint64), k, bits)[0]) for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    counts = {x: Counter(g for t, y in train if y == x for g in grams(t)) for x in letters}
    prior = Counter(y for _, y in train)

    def plain(text):
        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        g = grams(text.lower())
        logs = {x: math.log(prior[x] / len(train)) + sum(math.log((counts[x][k] + 0.5) / (sum(counts[x].values()) + 0.5 * (1 << bits))) for k in g) for x in sorted(letters)}
        top = max(logs, key=logs.get)
        return top, 1 / sum(math.exp(v - logs[top]) for v in logs.values())

    for block in (64, 3):
        monkeypatch.setattr(language_id, "BLOCK_LANGS", block)
        got = language_id.identify(docs).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        for d, t, _ in rows:
            lang, score = plain(t)
            assert by[d].lang_pred == lang and abs(by[d].score - score) < 1e-9, d
    models = language_id.fit(docs)
    assert sorted(r.doc_id for r in language_id.accepted(docs.where("doc_id >= 1000"), models).collect()) == [1003]
