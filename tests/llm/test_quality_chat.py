import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loomline.llm import chat_format, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def rows():
    rng = random.Random(3)
    words = ["ab", "c", "dé", "<|", "x\x0by", "日本", "#"]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "a b c d e f g h " * 3), (4, "same line\n" * 30)]
    for i in range(5, 140):
        out.append((i, "".join(rng.choice(words[: rng.randrange(1, 8)]) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(0, 90)))))
    good = ["alpha", "river", "stone", "walks", "under", "bright", "morning", "garden", "seven", "letters", "quiet", "market"]
    for i in range(200, 320):
        out.append((i, " ".join("".join(rng.sample(good, 2)) for _ in range(rng.randrange(40, 200))) + "."))
    return out


def test_features_and_verdict(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in rows()], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality_rules.report(df).collect()}
    for i, text in rows():
        r, want = got[i], brute(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, text)
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(got[i].kept for i in range(200, 320))
    assert not got[0].kept and not got[3].kept
    assert quality_rules.report(df.limit(0)).count() == 0


def test_accuracies_are_found(spark):
    """Votes drawn from known accuracies on good and on bad documents: EM finds them."""
    rng = random.Random(1)
    true = [(0.98, 0.8), (0.95, 0.7), (0.9, 0.6), (0.97, 0.5), (0.85, 0.75)]
    counts = Counter()
    for _ in range(30000):
        good = rng.random() < 0.8
        counts[tuple(0 if rng.random() < 0.2 else (1 if rng.random() < a else -1) if good else (-1 if rng.random() < b else 1) for a, b in true)] += 1
    df = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    share, acc = quality_rules.fit(df)
    assert abs(share - 0.8) < 0.03
    assert all(abs(g - a) < 0.03 and abs(x - b) < 0.06 for (g, x), (a, b) in zip(acc, true, strict=True)), acc


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>", "\\", "\\|", "<\\|", "\n", "é", "user", "<|", "|>", "\\n", "$1", "ok "]
    data = [(1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, "us\ner\\n", "t")]
    for c in range(10, 60):
        for t in range(rng.randrange(1, 7)):
            data.append((c, t, rng.choice(["system", "user", "assistant", "a<|b\\"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))))
    df = spark.createDataFrame([(*r, "clash") for r in data], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    by = {}
    for c, t, r, x in data:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    text = chat_format.format_conversations(df).where("conv_id = 3").select("formatted", "valid").first()
    assert text[0] == "<|im_start|>user\na<|im_end|>\n" + 2 * "<|im_start|>assistant\nb<|im_end|>\n" and text[1] is False
    assert chat_format.digests(df.limit(0)).count() == 0


def test_machine(spark):
    data = [(1, ["system", "user", "assistant"], None), (2, ["user"], 0), (3, ["assistant"], 0), (4, ["user", "tool", "assistant", "user", "assistant"], None), (5, ["user", "user", "assistant"], 1)]
    df = spark.createDataFrame([(c, roles) for c, roles, _ in data], "conv_id long, roles array<string>").select("conv_id", F.posexplode("roles").alias("turn", "role"), F.lit("t").alias("text"))
    got = {r.conv_id: (r.valid, r.first_bad) for r in chat_format.format_conversations(df).collect()}
    assert got == {c: (bad is None, bad) for c, _, bad in data}
