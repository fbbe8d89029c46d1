"""Arrow batches in Python workers, cut so that memory stays bounded."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from readloom.session import ship

SMALL = 2 << 20


#: Called at the end of each task: drops caches that modules keep.
at_end: list[Callable[[], None]] = []


def release() -> None:
    """Drops what modules keep, and gives free memory back to the system."""
    for forget in at_end:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """A task's function that gives its memory back at the end.

    Python workers live on and run the next stages beside the JVM; what the
    allocators keep for themselves would add up.
    """

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def by_bytes(sizes: list[int], most: int = SMALL) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about ``most``; one row at least each."""
    start = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def sizes_of(column: pa.Array) -> list[int]:
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def text_bytes(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and the length of each (null: 0)."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    if len(filled) == 0:
        return b"", np.zeros(0, dtype=np.int64)
    _, ends, data = filled.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    return (data.slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes() if data is not None else b""), np.diff(ends)


def map_batches(df: DataFrame, schema: str, sized_by: str, make: Callable[[], Callable]) -> DataFrame:
    """mapInArrow over pieces of a bounded size.

    ``make()`` runs once in each task and gives a function from a record batch
    to a list of arrays, one for each field of ``schema``.
    """
    ship(df.sparkSession)

    @tidy
    def run(batches):
        work = make()
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column(sized_by))):
                yield pa.RecordBatch.from_arrays(work(batch.slice(a, b - a)), names=names)

    target = StructType.fromDDL(schema)
    names = [f.name for f in target.fields]
    return df.mapInArrow(run, target)


def add_columns(df: DataFrame, schema: str, sized_by: str, make: Callable[[], Callable]) -> DataFrame:
    """As map_batches(), but the new columns stand behind those of ``df``.

    A column of ``df`` that has the name of a new one makes way for it.
    """
    new = StructType.fromDDL(schema).fields
    df = df.drop(*[f.name for f in new if f.name in df.columns])
    target = StructType(df.schema.fields + new)
    names = [f.name for f in target.fields]
    ship(df.sparkSession)

    @tidy
    def run(batches):
        work = make()
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column(sized_by))):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part)], names=names)

    return df.mapInArrow(run, target)
