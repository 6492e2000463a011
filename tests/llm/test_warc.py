"""WARC archives: round trips, revisits, determinism, damage and odd rows."""

import glob
import gzip
import hashlib
import io

import pytest
from loomline.llm import warc

SCHEMA = "page_id long, url string, html string"


def written(spark, tmp_path, rows, name="a", schema=SCHEMA, **more):
    root = f"file://{tmp_path}/{name}"
    manifest = warc.write(spark.createDataFrame(rows, schema).repartition(3), root, **more)
    return root, manifest


def expected(rows, least=warc.LEAST):
    """Of (page_id, url, html) the rows of the contract, by brute force."""
    out, first = [], {}
    for page_id, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (html or "").encode()
        revisit = page_id is not None and len(data) >= least and data in first
        if page_id is not None and len(data) >= least:
            first.setdefault(data, page_id)
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(out, key=repr)


def got(spark, root):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, root).collect()), key=repr)


ROWS = [
    *((i, f"http://a.example/{i}", f"<p>page {i % 7}</p>" + "x" * (i % 7) * 40) for i in range(60)),  # groups of copies, some short
    (100, None, None), (101, "http://b\r\nX: y/ \t", ""), (102, "", "é\x00퟿𝄞" * 50), (103, "http://c", "é\x00퟿𝄞" * 50),
    (None, "http://d", "z" * 200), (None, None, "z" * 200), (104, "http://e", "z" * 200), (105, "u", "z" * 200),
    (106, "same", "w" * 300), (106, "same", "w" * 300), (106, "other", "w" * 300), (106, "other", "v" * 10), (-(2**63) + 5, "low", "b"), (2**62, "high", "a" * 200_000),
]


def test_round_trip(spark, tmp_path):
    root, manifest = written(spark, tmp_path, ROWS, roll=2000, shards=3)
    assert got(spark, root) == expected(ROWS)
    files = manifest.collect()
    assert sum(r.n_records for r in files) == len(ROWS) and len(files) > 3  # rolled by size
    texts = [(r.page_id, bytes(r.payload)) for r in warc.read(spark, root).collect() if r.record_type == "response"]
    assert set(texts) <= {(p, (h or "").encode()) for p, _, h in ROWS} and {t for _, t in texts} == {(h or "").encode() for _, _, h in ROWS}
    assert not glob.glob(f"{tmp_path}/a/_temporary/*")


def test_sorted_and_deterministic(spark, tmp_path):
    _, one = written(spark, tmp_path, ROWS, "a", roll=2000, shards=4)
    _, two = written(spark, tmp_path, ROWS[::-1], "b", roll=2000, shards=4)
    files = {r.name: r.sha256 for r in one.collect()}
    assert files == {r.name: r.sha256 for r in two.collect()}
    spans = [(r.first_id, r.last_id) for r in sorted(one.collect(), key=lambda r: r.name) if r.first_id is not None]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    for name, sha in files.items():
        data = open(f"{tmp_path}/a/{name}", "rb").read()
        assert hashlib.sha256(data).hexdigest() == sha
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")


def test_damage_is_found(spark, tmp_path):
    root, manifest = written(spark, tmp_path, ROWS, shards=1)
    path = f"{tmp_path}/a/{manifest.first().name}"
    data = bytearray(open(path, "rb").read())
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(bytes(data[:-9])), 64))
    z = gzip.decompress(bytes(data)).replace(b"<p>page 3", b"<p>page 9", 1)
    open(path, "wb").write(gzip.compress(z))
    with pytest.raises(Exception, match="match|not a record|not the file"):
        warc.read(spark, root).collect()


def test_files_without_a_manifest_do_not_count(spark, tmp_path):
    root, manifest = written(spark, tmp_path, ROWS[:5], shards=1)
    name = manifest.first().name
    open(f"{tmp_path}/a/left-by-a-lost-task.warc.gz", "wb").write(b"half")
    assert len(got(spark, root)) == 5
    # promoting again does no harm
    files = spark.createDataFrame([r.asDict() | {"written": f"gone-{r.name}"} for r in manifest.collect()], warc._FILES)
    assert [r.name for r in warc._committed(files, root).collect()] == [name]


def test_one_page_holds_a_third(spark, tmp_path):
    rows = [(7, f"u{i % 3}", f"{i:050d}" * 3) for i in range(90)] + [(i, "u", "t" * 150) for i in range(100, 280)]
    root, manifest = written(spark, tmp_path, rows, shards=9)
    assert got(spark, root) == expected(rows)
    sizes = [r.n_records for r in manifest.collect()]
    assert max(sizes) <= 90


def test_empty_and_other_columns(spark, tmp_path):
    root, manifest = written(spark, tmp_path, [], schema=SCHEMA)
    assert manifest.count() == 0 and warc.read(spark, root).count() == 0
    rows = [(1, "u", "h" * 100, "a", 5, "d"), (2, "u", "h" * 100, "b", 6, "e")]
    root, _ = written(spark, tmp_path, rows, "c", "page_id long, url string, html string, payload string, shard int, digest string")
    assert got(spark, root) == expected([r[:3] for r in rows])
