"""Merkle manifests: equal to a plain recursion, in any number of stages; merging forests in any order."""

import random
import zlib
from itertools import groupby

from loomline.llm import merkle
from pyspark.sql import functions as F

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
H = merkle.hashed


def leaf(r, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(map(enc, (r[0], r[1], r[2], r[3], text))))


def tree(nodes):
    """(root, siblings of each leaf by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf_, i in enumerate(at):
            low = i - i % 8
            paths[leaf_].append((nodes[low:i], nodes[i + 1 : low + 8]))
        nodes, at = [H("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def brute(rows):
    lang = lambda r: (r[2] is not None, (r[2] or "").encode())
    order = sorted(rows, key=lambda r: (lang(r), r[0] is not None, r[0] or 0, leaf(r, r[4])))
    parts = [list(g) for _, g in groupby(order, key=lang)]
    below = [tree([leaf(r, r[4]) for r in p]) for p in parts]
    root, above = tree([x for x, _ in below]) if parts else (None, [])
    out = []
    for part, (sub, paths), top in zip(parts, below, above, strict=True):
        for r, path in zip(part, paths, strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf(r, r[4] if not bad or r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            for b, a in path + top:
                now = H("".join([*b, now, *a]))
            out.append((r[0], leaf(r, r[4]), sub, root, H("".join("".join(b + a) for b, a in path + top)), now, now == root))
    return sorted(out, key=repr)


def got(spark, rows, schema=SCHEMA, **more):
    docs = spark.createDataFrame(rows, schema).repartition(3)
    if more:
        lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        out = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower, **more)
    else:
        out = merkle.report(docs)
    return sorted((tuple(r) for r in out.collect()), key=repr)


def rows(n, langs, seed=1):
    r = random.Random(seed)
    return [(i, r.choice(["web", None, ""]), r.choice(langs), r.choice([None, i]), r.choice([None, "", "Text É ß ǅ" * r.randrange(5), "abc"])) for i in r.sample(range(-n, 3 * n), n)]


def test_equal_to_brute_force(spark):
    for n, langs in ((700, ["en"] * 9 + ["de", None, "", "é", "𝄞"]), (1, [None]), (8, ["x"]), (9, ["x"]), (64, ["x"]), (65, ["x", "y"])):
        data = rows(n, langs)
        assert got(spark, data) == brute(data), n
    assert got(spark, []) == []


def test_more_stages_give_the_same(spark):
    data = rows(700, ["en"] * 9 + ["de", None]) + rows(120, [str(i) for i in range(90)], 2)
    want = brute(data)
    assert got(spark, data, levels=1, held=20) == want  # chunks of 8, several stages, then treeReduce
    assert got(spark, data, levels=2, held=4) == want


def test_repeated_and_null_ids(spark):
    data = [(1, "a", "en", 1, "T")] * 30 + [(None, "a", "en", 1, f"T{i % 3}") for i in range(40)] + [(2, None, None, None, None)] * 3 + [(3, "a", "en", 5, "Long " * 50_000)]
    assert got(spark, data) == brute(data)


def test_other_columns(spark):
    data = [(*r, 1, "x", "y") for r in rows(30, ["en", None])]
    assert got(spark, data, SCHEMA + ", tree long, node string, path string") == brute([r[:5] for r in data])


def test_forests_merge_in_any_order():
    r = random.Random(3)
    for n in (1, 7, 8, 9, 63, 64, 65, 200, 600):
        leaves = [H(str(i)) for i in range(n)]
        root, paths = tree(leaves)
        parts = [merkle.Forest({"t": n}) for _ in range(7)]
        for i in r.sample(range(n), n):
            r.choice(parts).add("t", 0, i, leaves[i])
        while len(parts) > 1:
            a, b = r.sample(range(len(parts)), 2)
            both = parts[a].merge(parts[b])
            parts = [p for i, p in enumerate(parts) if i not in (a, b)] + [both]
        assert parts[0].root("t") == root and len(parts[0].nodes) == 1
        i = r.randrange(n)
        assert parts[0].path("t", i) == [("".join(b), "".join(a)) for b, a in paths[i]]
