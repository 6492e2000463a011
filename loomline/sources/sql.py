"""What SQL can call: table functions for elements and fragments, and a data source for trees of source files.

``register(spark)`` makes these known to a session:

* ``elements(location, code)`` as a lateral table function gives the elements of each file,
* ``fragments(text, target)`` its overlapping pieces,
* ``spark.read.format("source_tree")`` reads a folder in splits of about ``splitBytes`` bytes, so that many small files
  are one task and large ones are tasks of their own.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType

from loomline.operators import extract, fragments

#: What a lateral call gives of an element; ids are expressions over these (``functions.keys``).
ELEMENTS = "type string, name string, line int, col int, end_line int, end_col int, level int, parent_type string, parent_name string, is_defined boolean, condition string, owner string, code string"
_NAMES = tuple(part.split()[0] for part in ELEMENTS.split(", "))
FRAGMENTS = "idx int, start int, stop int, code string"


@udtf(returnType=ELEMENTS)
class Elements:
    """The elements of one file; none of a null or of one that can't be read."""

    def eval(self, location: str, code: str) -> Iterator[tuple]:
        for e in extract.scan(code, location or "", signatures=False)[0] if code else []:
            yield tuple(e.get(n) for n in _NAMES)


@udtf(returnType=FRAGMENTS)
class Fragments:
    """The overlapping pieces of one text."""

    def eval(self, text: str, target: int) -> Iterator[tuple]:
        for i, (a, b) in enumerate(fragments.split_overlapping(text, target) if text and target else []):
            yield i, a, b, text[a:b]


class _Split(InputPartition):
    def __init__(self, files: list[str]) -> None:
        super().__init__(0)
        self.files = files


class _TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        from pyarrow.fs import FileSystem

        options = {k.lower(): v for k, v in options.items()}
        path = options["path"]
        self.uri = path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path)
        self.wanted = options.get("extensions", "cpp,cc,cxx,c").split(",")
        self.least = int(options.get("splitbytes", 1 << 25))
        self.base = FileSystem.from_uri(self.uri)[1].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        """Files by path, in runs of about so many bytes."""
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, path = FileSystem.from_uri(self.uri)
        files = sorted((f.path, f.size) for f in fs.get_file_info(FileSelector(path, recursive=True)) if f.type == FileType.File and any(fnmatch.fnmatch(f.path, f"*.{x}") for x in self.wanted))
        out, size = [[]], 0
        for name, n in files:
            if out[-1] and size + n > self.least:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [_Split(x) for x in out if x] or [_Split([])]

    def read(self, partition: _Split) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(self.uri)
        schema = pa.schema([("location", pa.string()), ("code", pa.string()), ("n_bytes", pa.int64())])
        for name in partition.files:
            with fs.open_input_stream(name, compression=None) as f:
                data = f.read()
            yield pa.RecordBatch.from_arrays([pa.array([name[len(self.base) + 1 :]]), pa.array([data.decode("utf-8", "replace")]), pa.array([len(data)], pa.int64())], schema=schema)


class SourceTree(DataSource):
    """(location, code, n_bytes) of the files below ``path`` with one of ``extensions``; bytes that are not UTF-8 become U+FFFD."""

    SCHEMA = "location string, code string, n_bytes long"

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.udtf.register("elements", Elements)
    spark.udtf.register("fragments", Fragments)
    spark.dataSource.register(SourceTree)
