"""Opening files from drivers and workers, and telling formats apart."""

from __future__ import annotations

import os
import shutil
import sys
from urllib.parse import quote

from pyspark.sql import SparkSession

from readloom.session import scratch


class UnsupportedFormat(ValueError):
    """A known format that cannot be read."""


def as_uri(path: str) -> str:
    """A URI of a path or URI, whose blanks and the like are encoded."""
    if "://" in path or path.startswith("file:"):
        return quote(path, safe="%/:@?&=+,;~!$'()*[]#")
    return "file://" + quote(os.path.abspath(path))


def open_file(path: str, write: bool = False):
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(as_uri(path))
    if write:
        where.create_dir(os.path.dirname(inner), recursive=True)
        return where.open_output_stream(inner, compression=None)
    return where.open_input_file(inner)


def spooled(spark: SparkSession, path: str) -> str:
    """The path; for ``-`` that of a copy of standard input in the shared folder."""
    if path != "-":
        return path
    target = scratch(spark, "stdin")
    target = "file://" + target[len("file:") :] if target.startswith("file:/") and "://" not in target else target
    with open_file(target, write=True) as f:
        shutil.copyfileobj(sys.stdin.buffer, f)
    return target


def print_file(path: str) -> None:
    """Copies a file to standard output."""
    with open_file(path) as f:
        while piece := f.read(1 << 20):
            sys.stdout.buffer.write(piece)
    sys.stdout.buffer.flush()


def file_size(path: str) -> int:
    with open_file(path) as f:
        return f.size()


def sniff(path: str) -> str:
    """``bam``, ``gzip`` or ``sam`` by the first 18 bytes; names do not matter."""
    with open_file(path) as f:
        head = f.read(18)
    if head[:4] == b"CRAM" and head[4:5] in (b"\2", b"\3"):
        raise UnsupportedFormat(f"{path}: CRAM files cannot be read")
    if head[:2] == b"\x1f\x8b":
        return "bam" if len(head) == 18 and head[3] & 4 and head[12:14] == b"BC" else "gzip"
    return "sam"


def splits(paths: list[str], size: int = 128 << 20) -> list[tuple[int, str, int, int]]:
    """(file number, path, start, end) of byte ranges."""
    out = []
    for i, path in enumerate(paths):
        total = file_size(path)
        step = size if sniff(path) == "sam" else max(total, 1)
        out += [(i, path, a, min(a + step, total)) for a in range(0, max(total, 1), step)]
    return out


def splits_frame(spark: SparkSession, paths: list[str], size: int):
    rows = splits(paths, size)
    return spark.createDataFrame(rows, "source int, source_file string, start bigint, stop bigint").repartition(max(1, len(rows)))
