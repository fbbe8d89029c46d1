"""BAM files: BGZF blocks, headers, and records to and from bytes."""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from readloom.functions.cigar import LEVELS, OPERATORS
from readloom.functions.flags import FormatError
from readloom.functions.seq import NUCLEOTIDES
from readloom.session import ship
from readloom.sources.files import as_uri, open_file
from readloom.sources.header import HeaderCatalog

#: Fixed value: the empty block at the end of a file.
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_BLOCK = 0xFF00
_AUX = "array<struct<tag:string,type:string,value:string>>"
DDL = (
    "source int, source_file string, ordinal bigint, qname string, flag int, rindex int, rname string, pos bigint, zpos bigint, mapq int, cigar string, "
    f"mate_rindex int, mate_rname string, mate_pos bigint, mate_zpos bigint, isize bigint, seq string, qual string, aux {_AUX}"
)
_AUX_ARROW = pa.list_(pa.struct([("tag", pa.string()), ("type", pa.string()), ("value", pa.string())]))
SCHEMA = pa.schema(
    [("source", pa.int32()), ("source_file", pa.string()), ("ordinal", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rindex", pa.int32()), ("rname", pa.string()),
     ("pos", pa.int64()), ("zpos", pa.int64()), ("mapq", pa.int32()), ("cigar", pa.string()), ("mate_rindex", pa.int32()), ("mate_rname", pa.string()), ("mate_pos", pa.int64()),
     ("mate_zpos", pa.int64()), ("isize", pa.int64()), ("seq", pa.string()), ("qual", pa.string()), ("aux", _AUX_ARROW)]
)
_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f", "d": "<d"}


def blocks(stream):
    """(offset, content) of each BGZF block; lengths and checksums are verified."""
    offset = 0
    while head := stream.read(12):
        if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
            raise FormatError("not a BGZF block")
        extra = stream.read(struct.unpack("<H", head[10:12])[0])
        size, at = None, 0
        while at + 4 <= len(extra):
            length = struct.unpack("<H", extra[at + 2 : at + 4])[0]
            if extra[at : at + 2] == b"BC" and length == 2:
                size = struct.unpack("<H", extra[at + 4 : at + 6])[0] + 1
            at += 4 + length
        if size is None:
            raise FormatError("a BGZF block without its size")
        body = stream.read(size - 12 - len(extra))
        if len(body) != size - 12 - len(extra):
            raise FormatError("a truncated BGZF block")
        try:
            data = zlib.decompress(body[:-8], -15)
        except zlib.error as e:
            raise FormatError(f"a damaged BGZF block: {e}") from e
        crc, length = struct.unpack("<II", body[-8:])
        if len(data) != length or zlib.crc32(data) != crc:
            raise FormatError("a BGZF block fails its checksum")
        yield offset, data
        offset += size


def make_block(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    if len(body) > 0xFFFF - 26:
        return make_block(data[: len(data) // 2], level) + make_block(data[len(data) // 2 :], level)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class _Bytes:
    """Reads across blocks and knows the virtual offset of what comes next."""

    def __init__(self, stream):
        self.blocks, self.data, self.at, self.offset = blocks(stream), b"", 0, 0

    def read(self, n: int, may_end: bool = False) -> bytes:
        while self.at >= len(self.data):
            got = next(self.blocks, None)
            if got is None:
                if n and not may_end:
                    raise FormatError("a truncated record")
                return b""
            self.offset, self.data, self.at = *got, 0
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        while len(out) < n:
            got = next(self.blocks, None)
            if got is None:
                raise FormatError("a truncated record")
            self.offset, self.data = got
            self.at = min(n - len(out), len(self.data))
            out += self.data[: self.at]
        return out

    def place(self) -> int:
        return (self.offset << 16) | self.at


def _read_header(source: _Bytes) -> HeaderCatalog:
    if source.read(4) != b"BAM\1":
        raise FormatError("not a BAM file")
    text = source.read(struct.unpack("<i", source.read(4))[0]).split(b"\0", 1)[0].decode()
    references = []
    for _ in range(struct.unpack("<i", source.read(4))[0]):
        name = source.read(struct.unpack("<i", source.read(4))[0])[:-1].decode()
        references.append((name, struct.unpack("<i", source.read(4))[0]))
    return HeaderCatalog([x for x in text.split("\n") if x], references)


def read_header(path: str) -> HeaderCatalog:
    with open_file(path) as f:
        return _read_header(_Bytes(f))


def _aux(data: bytes) -> list[dict]:
    out, at = [], 0
    while at < len(data):
        tag, kind, at = data[at : at + 2].decode(), chr(data[at + 2]), at + 3
        if kind in _FORMATS:
            size = struct.calcsize(_FORMATS[kind])
            (value,) = struct.unpack(_FORMATS[kind], data[at : at + size])
            text = format(value, ".9g") if kind == "f" else repr(value) if kind == "d" else str(value)
        elif kind == "A":
            size, text = 1, chr(data[at])
        elif kind in "ZH":
            size = data.index(b"\0", at) - at + 1
            text = data[at : at + size - 1].decode()
        elif kind == "B":
            sub, (n,) = chr(data[at]), struct.unpack("<i", data[at + 1 : at + 5])
            form = "<" + str(n) + _FORMATS[sub][1]
            size = 5 + struct.calcsize(form)
            text = ",".join([sub, *(format(v, ".9g") if sub == "f" else str(v) for v in struct.unpack(form, data[at + 5 : at + size]))])
        else:
            raise FormatError(f"auxiliary field of unknown type {kind!r}")
        out.append({"tag": tag, "type": kind, "value": text})
        at += size
    return out


def decode_record(data: bytes, catalog: HeaderCatalog) -> tuple:
    """A record's columns from qname on."""
    rindex, zpos, name_length, mapq, _, n_ops, flag, length, mate, mate_zpos, isize = struct.unpack("<iiBBHHHiiii", data[:32])
    at = 32 + name_length
    qname = data[32 : at - 1].decode()
    ops = struct.unpack(f"<{n_ops}I", data[at : at + 4 * n_ops])
    at += 4 * n_ops
    packed = data[at : at + (length + 1) // 2]
    at += (length + 1) // 2
    seq = "".join(NUCLEOTIDES[b >> 4] + NUCLEOTIDES[b & 15] for b in packed)[:length]
    qual = data[at : at + length]
    text = None if length == 0 or qual[0] == 0xFF else "".join(chr(min(q, 93) + 33) for q in qual)
    cigar = "".join(f"{x >> 4}{OPERATORS[x & 15]}" for x in ops) or "*"
    return (qname, flag, rindex, catalog.find_reference(rindex)[0], zpos + 1, zpos, mapq, cigar, mate, catalog.find_reference(mate)[0], mate_zpos + 1, mate_zpos, isize, seq, text, _aux(data[at + length :]))


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Records of BAM files: one task for each file, virtual offsets as ordinals."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for number, path in zip(batch.column("source").to_pylist(), batch.column("source_file").to_pylist()):
                with open_file(path) as f:
                    source, held = _Bytes(f), []
                    catalog = _read_header(source)
                    while True:
                        place = source.place()
                        size = source.read(4, may_end=True)
                        if not size:
                            break
                        record = source.read(struct.unpack("<i", size)[0])
                        held.append((number, path, place, *decode_record(record, catalog)))
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), SCHEMA)], schema=SCHEMA)
                            held = []
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), SCHEMA)], schema=SCHEMA)

    rows = spark.createDataFrame([(i, as_uri(p)) for i, p in enumerate(paths)], "source int, source_file string").repartition(max(1, len(paths)))
    return rows.mapInArrow(run, DDL)


def _integer_type(value: int) -> str:
    for kind, low, high in (("c", -128, 127), ("C", 0, 255), ("s", -32768, 32767), ("S", 0, 65535), ("i", -(1 << 31), (1 << 31) - 1), ("I", 0, (1 << 32) - 1)):
        if low <= value <= high:
            return kind
    raise FormatError(f"an integer out of range: {value}")


def _pack_aux(fields: list[dict] | None) -> bytes:
    out = []
    for x in fields or []:
        tag, kind, value = x["tag"].encode(), x["type"], x["value"]
        if kind in "cCsSiI":
            kind = _integer_type(int(value)) if kind == "i" else kind
            body = struct.pack(_FORMATS[kind], int(value))
        elif kind in "fd":
            body = struct.pack(_FORMATS[kind], float(value))
        elif kind == "A":
            body = value.encode()
        elif kind in "ZH":
            body = value.encode() + b"\0"
        elif kind == "B":
            sub, *numbers = value.split(",")
            read = float if sub in "fd" else int
            body = sub.encode() + struct.pack(f"<i{len(numbers)}{_FORMATS[sub][1]}", len(numbers), *map(read, numbers))
        else:
            raise FormatError(f"auxiliary field of unknown type {kind!r}")
        out.append(tag + kind.encode() + body)
    return b"".join(out)


def encode_record(row: dict, catalog: HeaderCatalog) -> bytes:
    """A record's bytes with its length in front; names over 254 bytes raise."""
    import re

    qname = row["qname"].encode() + b"\0"
    if len(qname) > 255:
        raise FormatError(f"a read name of {len(qname) - 1} bytes")
    ops = [(int(n), OPERATORS.index(op)) for n, op in re.findall(r"(\d+)(.)", row["cigar"] or "")] if row["cigar"] not in (None, "*") else []
    seq = row["seq"] or ""
    codes = [NUCLEOTIDES.find(c) for c in seq.upper().replace(".", "N")]
    if -1 in codes:
        raise FormatError(f"not a sequence: {seq!r}")
    packed = bytes((codes[i] << 4) | (codes[i + 1] if i + 1 < len(codes) else 0) for i in range(0, len(codes), 2))
    qual = bytes(ord(c) - 33 for c in row["qual"]) if row["qual"] is not None else b"\xff" * len(seq)
    zpos = row["pos"] - 1
    span = max(1, sum(n for n, op in ops if OPERATORS[op] in "MDN=X")) if not row["flag"] & 4 else 1
    right = zpos + span - 1
    number = next((first + (zpos >> shift) for shift, first in LEVELS if zpos >> shift == right >> shift), 0) & 0xFFFF
    index = lambda name: -1 if name == "*" else catalog.index[name]
    body = struct.pack("<iiBBHHHiiii", index(row["rname"]), zpos, len(qname), row["mapq"], number, len(ops), row["flag"], len(seq), index(row["mate_rname"]), row["mate_pos"] - 1, row["isize"])
    body += qname + b"".join(struct.pack("<I", (n << 4) | op) for n, op in ops) + packed + qual + _pack_aux(row.get("aux"))
    return struct.pack("<i", len(body)) + body


class BamWriter:
    """Writes header and records in blocks; level 0 stores without compressing."""

    def __init__(self, stream, catalog: HeaderCatalog, level: int = 6):
        self.stream, self.catalog, self.level, self.held = stream, catalog, level, bytearray()
        text = catalog.text().encode()
        self._put(b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(catalog.references)))
        for name, length in catalog.references:
            self._put(struct.pack("<i", len(name.encode()) + 1) + name.encode() + b"\0" + struct.pack("<i", length))

    def _put(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= _BLOCK:
            self.stream.write(make_block(bytes(self.held[:_BLOCK]), self.level))
            del self.held[:_BLOCK]

    def write(self, row: dict) -> None:
        self._put(encode_record(row, self.catalog))

    def close(self) -> None:
        if self.held:
            self.stream.write(make_block(bytes(self.held), self.level))
        self.stream.write(END_BLOCK)
