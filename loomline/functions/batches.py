"""Arrow batches in small parts: what a worker holds does not grow with a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a part; a row of more is a part of its own.
PART = 1 << 22


def small(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[pa.RecordBatch]:
    """All rows, in order, in parts of at most so many bytes. Rows as Python objects, and what is made of them, take several
    times the memory of a batch, and a batch is 10,000 rows of any length. After each batch memory is given back."""
    for b in batches:
        yield from _halved(b, most)
        del b
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim is not None:
            trim(0)


def _halved(b: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    if b.num_rows < 2 or b.nbytes <= most:
        yield b
        return
    half = b.num_rows // 2
    yield from _halved(b.slice(0, half), most)
    yield from _halved(b.slice(half), most)
