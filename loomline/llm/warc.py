"""WARC archives: a deterministic sharded writer with revisit records, and a reader that checks what it reads.

Records are sorted by page_id over shards. Edges between shards come from sums of payload bytes over ranges of page_id, which
are refined where they are heavy, so that the same rows, and number of shards, always give the same files. A task writes
its shard record by record, each a gzip member of its own, and rolls to the next file by compressed size. Headers, record ids
and digests are made anew from the rows. Files are written under names of the attempt's own; the rows of the attempts that Spark committed
form the manifest, files that it names are renamed, and only then the manifest is written: archives count once they are
in it. Lost or repeated tasks leave at most files that no manifest names, and these go at the end.

Of equal payloads of at least ``LEAST`` bytes the record with the smallest page_id is the response; the others are revisits of it,
without the payload. Who revisits whom is decided on digests alone; it meets the pages as rows of their own that sort
before them, so payloads are shuffled once.

Defined results: a null payload is empty; a null url has no header, and control characters and blanks in a url are percent-encoded;
records with a null page_id are responses that nothing revisits; of repeated rows of a page_id with
equal payloads the first is the response, if it is one, and the others revisit it; very long payloads are one record each; an
empty table gives a manifest without files; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import lean, partitions, shared_dir, stored

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Compressed bytes after which a file is full, and payload bytes of a shard.
ROLL, SHARD = 1 << 28, 1 << 30
DATE = "1970-01-01T00:00:00Z"
#: Parts that a heavy range of page_id is cut into.
_CELLS = 64

_FILES = "name string, written string, shard int, n_records long, n_bytes long, sha256 string, first_id long, last_id long"
_RECORDS = "file string, offset long, record_type string, page_id long, refers_to long, url string, record_id string, payload_bytes long, payload_digest string, payload binary"


def _folder(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _within(page_id: pd.Series, prefix: pd.Series, edges: np.ndarray, heavy: dict[int, tuple[int, int]]) -> pd.Series:
    """The number of the range between edges that holds each id; an id alone in a heavy range is dealt by the digest's prefix."""
    known = page_id.notna().to_numpy()
    ids = page_id.fillna(0).astype("int64").to_numpy()
    at = np.searchsorted(edges, ids, "right").astype(np.int64)
    for key, (first, n) in heavy.items():
        mine = ids == key
        at[mine] = first + (prefix.to_numpy()[mine].astype(np.int64) * n >> 16)
    at[~known] = -1
    return pd.Series(at.astype(np.int32))


def edges(keys: DataFrame, shards: int) -> tuple[list[int], dict[int, tuple[int, int]], int]:
    """(edges, heavy, number of shards): page_ids at which a shard begins, and ids that are several shards by themselves.

    keys (page_id, n) is read once for each refinement; sums of ranges reach the driver, at most ``_CELLS`` for each shard.
    """
    known = keys.where("page_id IS NOT NULL")
    low, high, total = known.agg(F.min("page_id"), F.max("page_id"), F.sum(F.col("n") + 1)).first()
    if low is None:
        return [], {}, shards
    limit, cuts, open_ = max(1, total // shards), [low], [(low, high + 1)]
    while open_:
        for a, b in open_:
            cuts += [a + (b - a) * i // _CELLS for i in range(1, _CELLS)]
        cuts = sorted(set(cuts))
        at, last = np.array(cuts, np.int64), [*cuts[1:], high + 1]
        number = F.pandas_udf(lambda c: pd.Series(np.searchsorted(at, c.to_numpy(), "right").astype(np.int32) - 1), "int")
        sizes = {r.cell: r.n for r in known.groupBy(number("page_id").alias("cell")).agg(F.sum(F.col("n") + 1).alias("n")).collect()}
        open_ = [(cuts[c], last[c]) for c, n in sizes.items() if 4 * n > limit and last[c] - cuts[c] > 1]
    starts, heavy, filled, number = [], {}, 0, 0
    for c, a in enumerate(cuts):
        n = sizes.get(c, 0)
        if filled and filled + n > limit:
            starts.append(a)
            number, filled = number + 1, 0
        if n > limit:  # one id
            heavy[a] = (number, -(-n // limit))
            number += heavy[a][1] - 1
            starts += [a + 1] * (heavy[a][1] - 1)
        filled += n
    return starts, heavy, max(number + 1, shards)


def _header(lines: list[tuple[str, object]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in lines if v is not None)


def _url(text: str | None) -> str | None:
    return None if text is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}:{copy}').urn}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, copy: int, refers_to: int | None, refers_url: str | None, date: str = DATE) -> bytes:
    """A response record, or a revisit record if there is something to refer to."""
    http = b"HTTP/1.1 200 OK\r\n" + _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))]) + b"\r\n"
    block = http if refers_to is not None else http + payload
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _id(page_id, digest, copy)), ("WARC-Date", date), ("WARC-Target-URI", _url(url)), ("Page-ID", page_id)]
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _id(refers_to, digest, 0)),
            ("WARC-Refers-To-Target-URI", _url(refers_url)), ("WARC-Refers-To-Date", date), ("Refers-To-Page-ID", refers_to),
        ]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + _header(head) + b"\r\n" + block + b"\r\n\r\n"


class _File:
    """One archive that is being written; its bytes depend on the records alone."""

    def __init__(self, root: str, name: str, shard: int, date: str) -> None:
        self.fs, path = _folder(f"{root}/_temporary")
        self.fs.create_dir(path, recursive=True)
        self.row = {"name": name, "written": f"{uuid.uuid4().hex}-{name}", "shard": shard, "n_records": -1, "n_bytes": 0, "first_id": None, "last_id": None}
        self.out, self.sha = self.fs.open_output_stream(f"{path}/{self.row['written']}", compression=None), hashlib.sha256()
        fields = _header([("software", "loomline"), ("format", "WARC File Format 1.1")])
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _id(None, name, 0)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(fields))]
        self.add(None, b"WARC/1.1\r\n" + _header(info) + b"\r\n" + fields + b"\r\n\r\n")

    def add(self, page_id: int | None, text: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        for part in (z.compress(text), z.flush()):
            self.out.write(part)
            self.sha.update(part)
            self.row["n_bytes"] += len(part)
        self.row["n_records"] += 1
        if page_id is not None:
            self.row["first_id"] = page_id if self.row["first_id"] is None else self.row["first_id"]
            self.row["last_id"] = page_id

    def close(self) -> dict:
        self.out.close()
        return self.row | {"sha256": self.sha.hexdigest()}


def write(pages: DataFrame, root: str, shards: int | None = None, roll: int = ROLL, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Archives of pages (page_id, url, html) below root; the manifest, as it is stored there."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    keys = stored(rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n")))
    if shards is None:
        total = keys.agg(F.sum("n")).first()[0] or 0
        shards = max(partitions(spark), -(-total // SHARD))
    starts, heavy, n = edges(keys, shards)

    # who revisits whom: digests only
    same = keys.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    first = same.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("to"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marks = same.join(first, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", F.col("to.page_id").alias("refers_to"), F.col("to.url").alias("refers_url"))
    both = rows.withColumns({"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string")}).unionByName(marks)
    at = np.array(starts, np.int64)
    number = F.pandas_udf(lambda ids, prefix: _within(ids, prefix, at, heavy), "int")
    prefix = F.conv(F.substring("digest", 1, 4), 16, 10).cast("int")
    shard = number(F.col("page_id"), prefix)
    shard = F.when(shard < 0, F.pmod(prefix, F.lit(n))).otherwise(shard)
    dealt = both.withColumn("shard", shard).repartitionById(n, F.col("shard")).sortWithinPartitions("page_id", "digest", F.col("payload").isNotNull(), "url")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, count = [], None, 0
        key, target, copy = None, (None, None), 0
        for b in batches:
            columns = [b.column(b.schema.get_field_index(x)) for x in ("page_id", "url", "payload", "digest", "refers_to", "refers_url", "shard")]
            for i in range(b.num_rows):
                page_id, url, text, digest, to, to_url, number = (c[i].as_py() for c in columns)
                if (page_id, digest) != key:
                    key, target, copy = (page_id, digest), (None, None), 0
                if text is None:  # a mark
                    target = (to, to_url)
                    continue
                refers = target if target[0] is not None and (target[0] != page_id or copy) else (None, None)
                if file is None or file.row["n_bytes"] >= roll:
                    if file is not None:
                        done.append(file.close())
                    file, count = _File(root, f"{number:06d}-{count:05d}.warc.gz", number, date), count + 1
                file.add(page_id, record(page_id, url, text, digest, copy, *refers, date))
                copy += 1
        if file is not None:
            done.append(file.close())
        yield pa.RecordBatch.from_pylist(done, schema=kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(_FILES))
    files = stored(dealt.mapInArrow(lean(written), _FILES))
    return _committed(files, root)


def _committed(files: DataFrame, root: str) -> DataFrame:
    """Renames what files names and then writes the manifest; doing it again does no harm."""
    spark = files.sparkSession

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileType

        fs, path = _folder(root)
        for b in batches:
            for r in b.to_pylist():
                source, target = f"{path}/_temporary/{r['written']}", f"{path}/{r['name']}"
                if fs.get_file_info(source).type != FileType.NotFound:
                    fs.move(source, target)
                elif fs.get_file_info(target).type == FileType.NotFound:
                    raise FileNotFoundError(f"{source} is gone and {target} is not there")
            yield b

    manifest = f"{root}/manifest.parquet"
    files.repartition(max(1, min(partitions(spark), files.count()))).mapInArrow(renamed, _FILES).drop("written").write.mode("overwrite").parquet(manifest)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_temporary")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.parquet(manifest)


def members(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes, int]]:
    """(offset, record, bytes read so far) of the gzip members of a stream; one record is held at a time."""
    z, parts, start, seen, data = zlib.decompressobj(31), [], 0, 0, b""
    while data or (data := stream.read(chunk)):
        parts.append(z.decompress(data))
        left = z.unused_data
        seen += len(data) - len(left)
        if z.eof:
            yield start, b"".join(parts), seen
            z, parts, start = zlib.decompressobj(31), [], seen
        data = left
    if seen != start:
        raise ValueError("the last record is cut off")


def parsed(text: bytes) -> dict:
    """The fields of a record; its digests are checked."""
    head, _, rest = text.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    field = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(field["Content-Length"])]
    if not version.startswith("WARC/1.") or len(block) != int(field["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a record")
    if field["WARC-Type"] not in ("response", "revisit"):
        return {"record_type": field["WARC-Type"]}
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(re.search(rb"Content-Length: (\d+)", http)[1]), field["WARC-Payload-Digest"].removeprefix("sha256:")
    sound = field["WARC-Block-Digest"] == f"sha256:{hashlib.sha256(block).hexdigest()}"
    if field["WARC-Type"] == "response":
        sound = sound and len(payload) == size and hashlib.sha256(payload).hexdigest() == digest
    if not sound:
        raise ValueError(f"digests of {field['WARC-Record-ID']} do not match")
    number = lambda x: int(field[x]) if x in field else None
    return {
        "record_type": field["WARC-Type"], "page_id": number("Page-ID"), "refers_to": number("Refers-To-Page-ID"), "url": field.get("WARC-Target-URI"), "record_id": field["WARC-Record-ID"],
        "payload_bytes": size, "payload_digest": digest, "payload": payload if field["WARC-Type"] == "response" else None,
    }


def read(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives that the manifest names; any that is not as written fails the job."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(_RECORDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _folder(root)
        for b in batches:
            for name, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sha, rows, held = hashlib.sha256(), [], 0

                class Hashed:
                    def __init__(self, f) -> None:
                        self.f = f

                    def read(self, n: int, sha=sha) -> bytes:
                        data = self.f.read(n)
                        sha.update(data)
                        return data

                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for offset, text, _ in members(Hashed(f)):
                        r = parsed(text)
                        if r["record_type"] == "warcinfo":
                            continue
                        rows.append({"file": name, "offset": offset} | (r if payload else r | {"payload": None}))
                        held += len(text) if payload else 256
                        if held > 1 << 22:
                            yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                            rows, held = [], 0
                if sha.hexdigest() != want:
                    raise ValueError(f"{name} is not the file that the manifest names")
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    files = spark.read.parquet(f"{root}/manifest.parquet").select("name", "sha256")
    return files.repartition(max(1, min(partitions(spark), files.count()))).mapInArrow(lean(run), _RECORDS)


def report(pages: DataFrame) -> DataFrame:
    """Writes archives of pages below the shared folder and reads them back."""
    spark = pages.sparkSession
    root = f"{shared_dir(spark)}/loomline/warc-{uuid.uuid4().hex}"
    write(pages, root)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return read(spark, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
