import hashlib
import random

import numpy as np
import pytest

from loomline.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    path = bpe.default_path()
    return bpe.Tokenizer(path), tokenizers.Tokenizer.from_file(path)


def test_same_ids_as_the_library(pair):
    ours, theirs = pair
    rng = random.Random(5)
    bits = ["the", " a", "a", "aaaa", "  ", "\n", "\t", "é", "日本", "😀", "<|endoftext|>", "'s", "1234", "!!", "zx", "Q", " ", "́", "ing", "\x00", "\r\n", "<|end"]
    texts = ["", " ", "a" * 5000, "ab" * 3000, " " * 999 + "x", "　x\x1c\x85y", *("".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(1500))]
    texts += ["".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(0xA0, 0x500), rng.randrange(0x1F300, 0x1F600)))) for _ in range(40)) for _ in range(500)]
    for text in texts:
        ids = ours.encode(text)
        assert ids == theirs.encode(text, add_special_tokens=False).ids, text
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_many_at_once_and_long_ones(pair, monkeypatch):
    ours, theirs = pair
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéüx\u4e2d\u6587") for _ in range(rng.randrange(1, 14)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(60)] + ["", "x" * 3000 + " <|endoftext|>y", "\u4e2d\u6587" * 40]
    want = [theirs.encode(x, add_special_tokens=False).ids for x in texts]
    as_ids = lambda packed: [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]
    assert list(map(as_ids, ours.packed(texts))) == want
    monkeypatch.setattr(bpe, "TOGETHER", 1000)  # long texts in parts, and a memory that keeps little
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    monkeypatch.setattr(bpe, "REMEMBERED_PAIRS", 500)
    assert list(map(as_ids, bpe.Tokenizer(bpe.default_path()).packed(texts))) == want


def test_broken_bytes(pair):
    ours, theirs = pair
    rng = random.Random(6)
    for _ in range(300):
        ids = [rng.randrange(ours.size) for _ in range(6)]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_frame(spark, pair):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "hello world", 0), (3, "hello world", 0)], "doc_id long, text string, ids int")
    path = bpe.default_path()
    got = {r.doc_id: r.asDict() for r in bpe.digests(docs, path).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert got[1]["n_tokens"] == 0 and got[2]["ids_sha256"] == empty == got[1]["decoded_sha256"]
    assert got[3]["decoded_sha256"] == hashlib.sha256(b"hello world").hexdigest()
    back = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(r.text for r in back.collect()) == ["", "", "hello world", "hello world"]
    assert bpe.digests(docs.limit(0), path).count() == 0


def test_beginnings_in_common_are_worked_out_once(pair, monkeypatch):
    """Not once for each piece that has them; also where one piece is another's beginning or bytes are zero."""
    ours, theirs = pair
    words = ["unconventional" + a + b for a in "abcdefgh" for b in ("", "x", "yz", "\x00")]
    steps, done = ours._steps, []
    monkeypatch.setattr(ours, "_steps", lambda state, byte: done.append(len(state)) or steps(state, byte))
    got = ours.pieces([w.encode() for w in words])
    one = [ours.piece(w.encode()) for w in words]
    assert got == one and all(theirs.encode(w, add_special_tokens=False).ids == np.frombuffer(x, "<u4").tolist() for w, x in zip(words, one, strict=True) if "\x00" not in w)
    assert sum(done) == len({w[:n] for w in words for n in range(1, len(w) + 1)})
