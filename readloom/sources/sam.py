"""Reading SAM text: headers on the driver, records in byte ranges."""

from __future__ import annotations

import gzip
import struct
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import aux, cigar, flags, seq
from readloom.operators.reads import lookup_index
from readloom.session import ship
from readloom.sources import bam
from readloom.sources.files import open_file, sniff, splits_frame, spooled
from readloom.sources.header import HeaderCatalog

COLUMNS = [
    "source", "source_file", "ordinal", "qname", "flag", "rindex", "rname", "pos", "zpos", "mapq", "cigar",
    "mate_rindex", "mate_rname", "mate_pos", "mate_zpos", "isize", "seq", "qual", "aux",
]
_PIECE = 8 << 20


def read_header(path: str) -> HeaderCatalog:
    """The header of a SAM or BAM file."""
    kind = sniff(path)
    if kind == "bam":
        return bam.read_header(path)
    lines = []
    with open_file(path) as raw:
        for line in gzip.open(raw) if kind == "gzip" else _lines(raw):
            if not line.startswith(b"@"):
                break
            lines.append(line.rstrip(b"\n").removesuffix(b"\r").decode())
    return HeaderCatalog(lines)


def _lines(stream):
    held = b""
    while piece := stream.read(1 << 16):
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


def header_end(path: str) -> int:
    """Where the header lines that lead a plain text file end."""
    at = 0
    with open_file(path) as raw:
        for line in _lines(raw):
            if not line.startswith(b"@"):
                break
            at += len(line) + 1
    return at


def _records(path: str, start: int, stop: int, head: int):
    """(offsets, bytes) of lines that begin in a byte range, behind the header lines that lead the file."""
    with open_file(path) as raw:
        zipped = sniff(path) == "gzip"
        stream = gzip.open(raw) if zipped else raw
        if zipped:
            start, stop = 0, 1 << 62
        at = max(0, start - 1)
        if not zipped:
            stream.seek(at)
        held, skipping, leading = b"", start > 0, zipped
        while True:
            piece = stream.read(_PIECE)
            data = held + piece
            if skipping:
                cut = data.find(b"\n")
                if cut < 0 and piece:
                    at, held = at + len(data), b""
                    continue
                at, data, skipping = at + cut + 1, data[cut + 1 :] if cut >= 0 else b"", False
            end = len(data) if not piece else data.rfind(b"\n") + 1
            block, held = data[:end], data[end:]
            if block:
                breaks = np.flatnonzero(np.frombuffer(block, dtype=np.uint8) == 10)
                starts = np.concatenate([[0], breaks + 1])
                ends = np.concatenate([breaks, [len(block)]])
                inside = (starts < len(block)) & (at + starts < stop) & (at + starts >= head)
                for a, b in zip(starts[inside].tolist(), ends[inside].tolist()):
                    if leading and block[a : a + 1] == b"@":
                        continue
                    leading = False
                    yield at + a, block[a:b]
                if at + len(block) >= stop:
                    return
            at += len(block)
            if not piece:
                return


def read_lines(spark: SparkSession, paths: list[str], split_bytes: int = 128 << 20, mode: str = "FAILFAST") -> DataFrame:
    """(source, source_file, ordinal, value): ordinal is the line's byte offset.

    Bytes that are not UTF-8 raise, or under DROPMALFORMED leave their line out.
    """
    ship(spark)
    schema = pa.schema([("source", pa.int32()), ("source_file", pa.string()), ("ordinal", pa.int64()), ("value", pa.string())])

    heads = {path: header_end(path) if sniff(path) == "sam" else 0 for path in paths}

    def text_of(path, ordinal, line):
        try:
            return line.decode()
        except UnicodeDecodeError as e:
            if mode == "DROPMALFORMED":
                return None
            raise flags.FormatError(f"not text in {path} at {ordinal}") from e

    def batch_of(source, path, held):
        held = [(o, t) for o, t in ((o, text_of(path, o, v)) for o, v in held) if t is not None]
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([source] * n, pa.int32()), pa.array([path] * n), pa.array([o for o, _ in held], pa.int64()), pa.array([t for _, t in held], pa.string())],
            schema=schema,
        )

    def run(batches):
        for batch in batches:
            for source, path, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                held = []
                for record in _records(path, start, stop, heads[path]):
                    held.append(record)
                    if len(held) == 8192:
                        yield batch_of(source, path, held)
                        held = []
                if held:
                    yield batch_of(source, path, held)

    return splits_frame(spark, paths, split_bytes).mapInArrow(run, "source int, source_file string, ordinal bigint, value string")


def _integer(text):
    """A decimal with an optional sign; empty is 0; other text raises."""
    wrong = F.raise_error(F.concat(F.lit("not a number: "), text)).cast("bigint")
    return F.when(text == "", F.lit(0).cast("bigint")).when(text.rlike("^[-+]?[0-9]+$"), text.cast("bigint")).otherwise(wrong)


def _well_formed(fields):
    """Whether every field of a record's list can be parsed."""
    f = [F.get(fields, F.lit(i)) for i in range(11)]
    number = lambda i: f[i].rlike("^([-+]?[0-9]+)?$")
    mapq = F.when(number(4) & (f[4] != ""), f[4].try_cast("bigint")).otherwise(0)
    return (
        f[1].rlike(flags.FLAG_FORM) & number(3) & number(4) & number(7) & number(8) & F.coalesce(mapq.between(0, 255), F.lit(False))
        & (f[5].isin("*", "") | f[5].rlike(f"^([0-9]+[{cigar.OPERATORS}])+$")) & f[10].rlike("^[!-~]*$") & F.forall(F.slice(fields, 12, 1 << 20), aux.aux_fits)
    )


def parse_lines(lines: DataFrame, references: DataFrame, mode: str = "FAILFAST", allow_undeclared: bool = False) -> DataFrame:
    """Typed records of SAM lines.

    mode: FAILFAST raises at a malformed record; DROPMALFORMED leaves malformed
    records out, whatever their fault.
    """
    parts = lines.withColumn("f", F.split(F.regexp_replace("value", "\r$", ""), "\t", -1))
    enough = F.size("f") >= 11
    f = lambda i: F.get("f", F.lit(i))
    seq_text, qual_text = f(9), f(10)
    lengths = (qual_text == "*") | ((seq_text != "*") & (F.length(seq_text) == F.length(qual_text)))
    if mode == "DROPMALFORMED":
        parts = parts.where(enough).where(lengths).where(_well_formed(F.col("f")))
    else:
        where = F.concat(F.lit(" in "), F.col("source_file"), F.lit(" at "), F.col("ordinal").cast("string"))
        bad = F.when(~enough, F.raise_error(F.concat(F.lit("too few fields"), where))).when(~lengths, F.raise_error(F.concat(F.lit("sequence and qualities differ in length"), where)))
        parts = parts.withColumn("f", F.coalesce(bad.cast("array<string>"), F.col("f")))
    mapq = _integer(f(4))
    rows = parts.select(
        "source", "source_file", "ordinal", f(0).alias("qname"), flags.parse_flags_column(f(1)).alias("flag"), f(2).alias("rname"), _integer(f(3)).alias("pos"),
        F.when(mapq.between(0, 255), mapq).otherwise(F.raise_error(F.lit("mapping quality out of range")).cast("bigint")).cast("int").alias("mapq"),
        cigar.cigar_text(cigar.cigar_ops(f(5))).alias("cigar"), F.when(f(6) == "=", f(2)).otherwise(f(6)).alias("mate_rname"),
        _integer(f(7)).alias("mate_pos"), _integer(f(8)).alias("isize"), F.when(f(9) == "*", "").otherwise(F.upper(F.translate(f(9), ".", "N"))).alias("seq"),
        F.when(f(10) == "*", F.lit(None)).otherwise(seq.qual_text(seq.qual_values(f(10)))).alias("qual"), aux.aux_parse(F.slice("f", 12, 1 << 20)).alias("aux"),
    )
    rows = rows.withColumn("zpos", F.col("pos") - 1).withColumn("mate_zpos", F.col("mate_pos") - 1)
    lenient = allow_undeclared or mode == "DROPMALFORMED"
    named = lookup_index(rows, references, "rname", "rindex", lenient)
    named = lookup_index(named, references, "mate_rname", "mate_rindex", lenient)
    if lenient and not allow_undeclared:
        known = lambda name, index: (F.col(name) == "*") | (F.col(index) >= 0)
        named = named.where(known("rname", "rindex") & known("mate_rname", "mate_rindex"))
    return named.select(*COLUMNS)


def read_alignments(
    spark: SparkSession, *paths: str, mode: str = "FAILFAST", allow_undeclared: bool = False, split_bytes: int = 128 << 20, bad_files: list[tuple[str, str]] | None = None
) -> DataFrame:
    """Records of SAM and BAM files, in any mixture; formats are told by content.

    ``-`` is standard input. A file that cannot be opened, or whose header is
    malformed, raises; with a list in ``bad_files`` it is noted there with its
    fault, and the next file is read.
    """
    frames = []
    for i, path in enumerate(paths):
        try:
            path = spooled(spark, path)
            kind, catalog = sniff(path), read_header(path)
        except (OSError, ValueError, struct.error, EOFError) as e:
            if bad_files is None:
                raise
            bad_files.append((path, str(e)))
            continue
        if kind == "bam":
            own = bam.read_records(spark, path)
        else:
            own = parse_lines(read_lines(spark, [path], split_bytes, mode), catalog.references_frame(spark), mode, allow_undeclared)
        frames.append(own.withColumn("source", F.lit(i)))
    if not frames:
        return spark.createDataFrame([], bam.DDL)
    return reduce(lambda a, b: a.unionByName(b), frames)
