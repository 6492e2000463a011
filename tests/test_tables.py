"""Tables that take upserts, and the store of responses on them: versions, crashes, and what is asked again."""

import glob

import pytest
from pyspark.sql import functions as F

from loomline.sources import model
from loomline.sources.tables import Table

SCHEMA = "k long, v string, at long"


def rows(table, version=None):
    return sorted((tuple(r) for r in table.read(version).collect()), key=repr)


def test_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], 8)
    assert t.read() is None and t.version() == 0 and t.lookup(spark.createDataFrame([(1,)], "k long")) is None
    assert t.upsert(spark.createDataFrame([(i, "a", i) for i in range(40)] + [(None, "n", 0)], SCHEMA)) == 1
    assert t.upsert(spark.createDataFrame([(3, "b", 0), (99, "b", 1), (None, "m", 2)], SCHEMA)) == 2
    want = {i: "a" for i in range(40)} | {3: "b", 99: "b", None: "m"}
    assert {r[0]: r[1] for r in rows(t)} == want and len(rows(t)) == len(want)
    assert {r[0]: r[1] for r in rows(t, 1)}[3] == "a"
    folders = {r.folder for r in t._folders(1)} & {r.folder for r in t._folders(2)}
    assert 5 <= len(folders) < 8  # only buckets that were touched are new
    assert sorted(r.k for r in t.lookup(spark.createDataFrame([(3,), (7,), (1000,)], "k long")).collect()) == [3, 7]
    assert t.upsert(spark.createDataFrame([], SCHEMA)) == 2
    old = t.read(1)
    t.upsert(spark.createDataFrame([(3, "c", 0)], SCHEMA))
    assert {r.k: r.v for r in old.collect()}[3] == "a"  # readers of an old version are not disturbed
    assert t.vacuum() > 0 and len(rows(t)) == len(want)


def test_order_decides(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], 4)
    t.upsert(spark.createDataFrame([(1, "new", 9), (1, "older", 3), (2, "x", 5)], SCHEMA), "at")
    t.upsert(spark.createDataFrame([(1, "late but old", 4), (2, "same", 5), (3, None, None)], SCHEMA), "at")
    assert {r[0]: r[1] for r in rows(t)} == {1: "new", 2: "same", 3: None}


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    t = Table(spark, f"file://{tmp_path}/t", ["k"], 4)
    t.upsert(spark.createDataFrame([(i, "a", 0) for i in range(20)], SCHEMA))
    before = rows(t)

    def die(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(Table, "_commit", die)
    with pytest.raises(KeyboardInterrupt):  # all data is written, the manifest is not
        t.upsert(spark.createDataFrame([(i, "b", 0) for i in range(20)], SCHEMA))
    monkeypatch.undo()
    assert rows(t) == before and t.version() == 1
    assert len(glob.glob(f"{tmp_path}/t/data/*")) == 2
    t.upsert(spark.createDataFrame([(i, "c", 0) for i in range(20)], SCHEMA))
    assert {r[1] for r in rows(t)} == {"c"} and t.version() == 2
    assert t.vacuum() == 2 and {r[1] for r in rows(t)} == {"c"}


def test_responses_are_asked_once(spark, tmp_path):
    store = Table(spark, f"file://{tmp_path}/s", ["prompt_sha256"], 4)
    log, broken = tmp_path / "asked", tmp_path / "broken"
    broken.write_text("bad")

    def client():
        def ask(prompts):
            with open(log, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            if any(p in broken.read_text().split() for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]

        return ask

    asked = spark.createDataFrame([(1, "one"), (2, "two"), (3, "one"), (4, None), (5, "bad")] + [(i, "hot") for i in range(10, 40)], "n long, prompt string")
    got = lambda: {r.n: (r.response, r.failed) for r in model.remembered(asked, store, client, tries=2, pause=0.01, batch=2, rounds=3).collect()}
    want = {1: ("ONE", False), 2: ("TWO", False), 3: ("ONE", False), 4: ("", False), 5: ("", True)} | {i: ("HOT", False) for i in range(10, 40)}
    assert got() == want
    assert store.read().where("failed").select("error").first()[0] == "RuntimeError: no"
    log.write_text("")
    broken.write_text("")
    assert got() == want | {5: ("BAD", False)}
    assert log.read_text().split() == ["bad"]  # only what failed


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    store = Table(spark, f"file://{tmp_path}/s", ["prompt_sha256"], 4)
    log = tmp_path / "asked"
    log.write_text("")
    asked = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "n long, prompt string")
    upsert, done = Table.upsert, []

    class Dies(Table):
        def upsert(self, *a):
            if len(done) == 2:
                raise KeyboardInterrupt
            done.append(upsert(self, *a))

    def client():
        def ask(prompts):
            with open(log, "a") as f:
                f.write("".join(p + "\n" for p in prompts))
            return prompts

        return ask

    dying = Dies(spark, store.path, store.key, 4)
    with pytest.raises(KeyboardInterrupt):
        model.remembered(asked, dying, client, rounds=5)
    have = {r.response for r in store.read().collect()}
    assert 0 < len(have) < 60
    log.write_text("")
    out = model.remembered(asked, store, client, rounds=5)
    assert {(r.n, r.response) for r in out.collect()} == {(i, f"p{i}") for i in range(60)}
    assert sorted(log.read_text().split()) == sorted({f"p{i}" for i in range(60)} - have)
    assert out.where(F.col("failed")).count() == 0
