"""Writing SAM and BAM files, whole or split by read group."""

from __future__ import annotations

import gzip
import os
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.export import sam_line
from readloom.operators.reads import filter_reads, read_group
from readloom.operators.split import DEFAULT_TEMPLATE, expand_template
from readloom.session import scratch, ship
from readloom.sources.bam import BamWriter
from readloom.sources.files import as_uri, open_file, print_file
from readloom.sources.header import HeaderCatalog

#: Formats by name: (binary, compression level, flag style).
FORMATS = {"sam": (False, 0, "dec"), "hex": (False, 0, "hex"), "text": (False, 0, "text"), "bam": (True, 6, "dec"), "ubam": (True, 0, "dec"), "sam.gz": (False, 6, "dec")}


def format_of(path: str) -> str:
    """The format that a name's ending stands for, in any case; SAM if none does."""
    return next((f for f in ("bam", "sam.gz") if path.lower().endswith("." + f)), "sam")


def format_column(path: Column) -> Column:
    """As format_of(), on a column."""
    low = F.lower(path)
    return F.when(low.endswith(".bam"), "bam").when(low.endswith(".sam.gz"), "sam.gz").otherwise("sam")


class _Sink:
    """One output file: header first, then batches of rows or lines."""

    def __init__(self, name: str, catalog: HeaderCatalog, format: str, header: bool, level: int | None = None):
        binary, usual, _ = FORMATS[format]
        level = usual if level is None else level
        self.name, self.stream = name, open_file(name, write=True)
        self.writer = self.zip = None
        if binary:
            self.writer = BamWriter(self.stream, catalog if header else HeaderCatalog(references=catalog.references), level)
            return
        if level:
            self.zip = gzip.GzipFile(fileobj=self.stream, mode="wb", compresslevel=level, mtime=0)
        (self.zip or self.stream).write((catalog.text() if header else "").encode())

    def write(self, batch: pa.RecordBatch) -> None:
        if self.writer:
            for row in batch.to_pylist():
                self.writer.write(row)
        elif batch.num_rows:
            (self.zip or self.stream).write(("\n".join(batch.column("line").to_pylist()) + "\n").encode())

    def close(self) -> None:
        for part in (self.writer, self.zip, self.stream):
            if part is not None:
                part.close()


def _columns(df: DataFrame, format: str) -> list[Column]:
    if format not in FORMATS:
        raise ValueError(f"not an output format: {format!r}; there are {', '.join(FORMATS)}")
    binary, _, style = FORMATS[format]
    names = ("qname", "flag", "rname", "pos", "mapq", "cigar", "mate_rname", "mate_pos", "isize", "seq", "qual", "aux")
    return [df[n] for n in names] if binary else [sam_line(df, style).alias("line")]


def write_alignments(df: DataFrame, catalog: HeaderCatalog, path: str, format: str | None = None, header: bool = True, parts: bool = False, level: int | None = None) -> list[str]:
    """Writes rows in their order and returns the files.

    Without a format the path's ending decides; ``-`` is standard output; a
    ``level`` of compression takes the place of the format's own.

    Without ``parts`` one file is streamed by one task; with it ``path`` is a
    folder and each task writes a complete file with the whole header. Files
    are written under other names and renamed by the driver when all succeeded,
    so a repeated task leaves no double.
    """
    format = format or format_of(path)
    rows = df.select(_columns(df, format))
    ship(df.sparkSession)
    if path == "-":
        target = scratch(df.sparkSession, "stdout")
        target = "file://" + target[len("file:") :] if target.startswith("file:/") and "://" not in target else target
        print_file(write_alignments(df, catalog, f"{target}/all", format, header, False, level)[0])
        return ["-"]
    run_id, folder = uuid.uuid4().hex, as_uri(path if parts else os.path.dirname(path) or ".")

    def run(batches):
        part = TaskContext.get().partitionId()
        sink = _Sink(f"{folder}/.{run_id}-{part:06d}-{uuid.uuid4().hex}", catalog, format, header, level)
        for batch in batches:
            sink.write(batch)
        sink.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [sink.name]})

    done = (rows if parts else rows.coalesce(1)).mapInArrow(run, "part int, name string").collect()
    if not done:  # no task ran: an output of the header alone
        target = f"{folder}/part-000000.{format}" if parts else as_uri(path)
        _Sink(target, catalog, format, header, level).close()
        return [target]
    targets = [f"{folder}/part-{r['part']:06d}.{format}" if parts else as_uri(path) for r in done]
    for r, target in zip(done, targets):
        _rename(r["name"], target)
    return sorted(targets)


def _rename(name: str, target: str) -> None:
    from pyarrow import fs

    where, inner = fs.FileSystem.from_uri(as_uri(name))
    where.move(inner, fs.FileSystem.from_uri(as_uri(target))[1])


def split_by_group(
    df: DataFrame, catalog: HeaderCatalog, source: str, folder: str, *flags: str, min_quality: int = 0, template: str = DEFAULT_TEMPLATE,
    format: str = "sam", order: tuple[str, ...] = ("source", "ordinal"), copy_to: str | None = None,
) -> dict[str, str]:
    """One file for each read group of the header, empty ones too, each with the whole header.

    All files are written in one pass: rows are dealt by group and a task opens
    a file for each of its groups in turn. A selected read without a group, or
    with one that the header lacks, raises.
    """
    folder, run_id = as_uri(folder), uuid.uuid4().hex
    names = {g: f"{folder}/{expand_template(template, dict(reversed(h.fields)), i, source, format)}" for i, (g, h) in enumerate(catalog.first_groups.items(), 1)}
    chosen = filter_reads(df, *flags, min_quality=min_quality)
    group = read_group(chosen)
    missing = F.raise_error(F.when(group.isNull(), "auxiliary field 'RG' not found").otherwise(F.concat(F.lit("no header for read group "), group))).cast("string")
    known = F.when(F.coalesce(group.isin(list(names)), F.lit(False)), group).otherwise(missing)
    columns = _columns(chosen, format)
    ship(df.sparkSession)
    rows = chosen.withColumn("split_rg", known).repartition(max(1, len(names)), "split_rg").sortWithinPartitions("split_rg", *order).select("split_rg", *columns)

    def run(batches):
        sink, now, done = None, None, []
        for batch in batches:
            groups, start = batch.column("split_rg").to_pylist(), 0
            while start < len(groups):
                stop = next((i for i in range(start, len(groups)) if groups[i] != groups[start]), len(groups))
                if groups[start] != now:
                    if sink:
                        sink.close()
                    now, sink = groups[start], _Sink(f"{folder}/.{run_id}-{uuid.uuid4().hex}", catalog, format, True)
                    done.append((now, sink.name))
                sink.write(batch.slice(start, stop - start))
                start = stop
        if sink:
            sink.close()
        yield pa.RecordBatch.from_pydict({"rg": pa.array([g for g, _ in done], pa.string()), "name": pa.array([n for _, n in done], pa.string())})

    written = {r["rg"]: r["name"] for r in rows.mapInArrow(run, "rg string, name string").collect()}
    for g, target in names.items():
        if g in written:
            _rename(written[g], target)
        else:
            _Sink(target, catalog, format, True).close()
    if copy_to is not None:
        write_alignments(chosen.orderBy(*order), catalog, copy_to, format)
    return names


def heads(*paths: str) -> str:
    """Header texts; banners if there are several files."""
    from readloom.sources.sam import read_header

    texts = [read_header(p).text() for p in paths]
    return texts[0] if len(paths) == 1 else "\n".join(f"==> {p} <==\n{t}" for p, t in zip(paths, texts))
