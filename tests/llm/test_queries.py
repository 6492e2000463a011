"""The registered queries on the smallest tables: against SQL where there is some, else for their contracts' shape."""

import hashlib
import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from loomline.llm import queries  # noqa: E402
from loomline.llm.common import stored  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = c.sql(queries.ORACLE[name])
    assert sorted(want.columns) == columns
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want.select(*columns).fetchall(), key=repr)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert 0 < docs.count() <= before


def test_pipeline_handles_odd_rows(spark, tmp_path):
    rows = [(1, None, None, "a", 3, "k"), (2, "", "en", "a", None, "k"), (3, "the same words again and again " * 30, "en", None, 1, "k"), (4, "the same words again and again " * 30, None, "a", 1, "k"), (5, "der token=abcdefgh12 und", "de", "a", 1, "k")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {3, 5}
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "e" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0


def test_pipeline_null_and_repeated_ids(spark, tmp_path):
    """Stage by stage: rows with a null doc_id stay, repeated rows stay, n_chars follows the text, clashing columns too."""
    words = lambda seed, n: " ".join(f"{w}{(i * seed) % 97}" for i, w in enumerate(["river", "stone", "cloud", "garden", "window"] * (n // 5)))
    long = words(7, 60)
    rows = [(None, long, "en", "a", 5), (None, long, "en", "a", 5), (7, long, "en", "a", None), (7, long, "en", "a", None), (9, long + " more", "en", "a", 1), (11, words(31, 40) + " password = hunter22x and more words", "en", "b", 1), (12, "?? 123", "en", "b", 6), (13, None, None, None, None)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone long, _loomline_runs string, _loomline_lang string")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(stages)[:-1]:
        docs = stored(stages[name](spark, docs, str(tmp_path)))
        kept[name] = docs.collect()
        assert len(docs.columns) == 8
    assert sorted(str(r.doc_id) for r in kept["language_id"]) == ["11", "7", "7", "9", "None", "None"]
    assert sorted(str(r.doc_id) for r in kept["near_dedup"]) == ["11", "7", "7", "None", "None"]  # 9 is a near copy of 7
    assert {r.n_chars == len(r.text) for r in kept["suffix_dedup"]} == {True}
    masked = next(r for r in kept["secret_scan"] if r.doc_id == 11)
    assert "hunter22x" not in masked.text and masked.n_chars == len(masked.text)
    pieces = stages["best_fit_packing"](spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in pieces) == ["11", "7", "7", "None", "None"]


@pytest.mark.parametrize("name", ["op2_bpe", "op3_secret_scan", "op4_simhash", "op5_quality_rules", "op6_packing", "op7_sharding", "op9_language_id"])
def test_registered_over_all_documents(spark, name):
    """Every registered query returns every document; what it returns holds together."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES[name](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs)
    if name != "op6_packing":
        assert len(rows) == len(docs)
    if name == "op2_bpe":
        assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)
    if name == "op3_secret_scan":
        kinds = [("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", "AKIA[A-Z0-9]+", 20, 0), ("hex", "[0-9a-f]+", 24, 0)]
        for r in rows:
            found = [(m.start(), i, m.end(), k) for i, (k, pattern, least, g) in enumerate(kinds) for m in re.finditer(pattern, docs[r.doc_id]) if len(m[g]) >= least]
            text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
            assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r.doc_id
            assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for *_, k in found) for x, *_ in kinds]
    if name == "op4_simhash":
        from_ = {r.doc_id: int(r.fingerprint, 16) for r in rows}
        label = {d: d for d in from_}
        for a in sorted(from_):
            for b in from_:
                if (from_[a] ^ from_[b]).bit_count() <= 3 and label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label = {d: low if x == high else x for d, x in label.items()}
        assert {r.doc_id: r.component_id for r in rows} == label
    if name == "op5_quality_rules":
        assert all(not r.kept for r in rows if r.base_failed) and any(r.kept for r in rows)
    if name == "op6_packing":
        assert sum(r.length for r in rows) == sum(max(r.start + r.length for r in rows if r.doc_id == d) for d in docs)
        assert len({r.sequence_id for r in rows}) <= 1.01 * sum(r.length for r in rows) / 2048 + 2
    if name == "op7_sharding":
        groups, sizes, slots = {}, dict.fromkeys(range(40), 0), {}
        for r in rows:
            groups.setdefault(docs[r.doc_id], set()).add(r.shard)
            sizes[r.shard] += r["size"]
            slots.setdefault(r.shard, []).append(r.slot)
            assert r["size"] == len(docs[r.doc_id].encode()) + 16
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        heavy = lambda t, n: (len(t.encode()) + 16) * n > sum(sizes.values()) / 160 or n > len(docs) / 160 or len(t.split()) * n > sum(len(d.split()) for d in docs.values()) / 160
        assert all(len(x) == 1 or heavy(t, sum(d == t for d in docs.values())) for t, x in groups.items())
    if name == "op9_language_id":
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        held = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
        assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_registered_search(spark):
    rows = queries.QUERIES["op8_nearest"](spark, SF).collect()
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert {r.query_id for r in rows} <= {i for i in ids if i % 100 == 0} and all(r.query_id != r.vec_id for r in rows)
    assert all(sorted(r["rank"] for r in rows if r.query_id == q) == list(range(1, 11)) for q in {r.query_id for r in rows})
