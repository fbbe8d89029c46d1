"""WARC archives: a writer, and a sequential reader that checks what it reads.

Each record is one gzip member. The reader feeds the file to zlib in small
pieces, ends a record where its member ends, takes the content by its declared
length and verifies the block and payload digests. Of pages with equal payloads
the one with the smallest page_id is a response record; the others revisit it
and store no payload.

Archives are written by the tasks into the folder that all machines share,
under names that no other attempt of a task uses; only files named in the
saved list of a finished write are read, so lost executors and repeated
tasks leave neither gaps nor doubles.

Payloads that more than one page in ``_HOT`` has are at most ``_HOT`` by
arithmetic: these go to the pages by broadcast, so that no large group of equal
pages meets in one task. All others are joined by shuffle.

Defined results: a null html is the empty payload; a null url gives no target;
rows that repeat the smallest page_id of a payload are all responses; a null
page_id is never the smallest, and if a payload has no other, all its records
are responses; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.arrow import by_bytes, sizes_of, tidy
from readloom.session import saved, scratch, ship

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PIECE = 1 << 16
_HOT = 10_000


class WarcError(ValueError):
    """An archive that breaks the format, or content that fails its digest."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _safe(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id: int | None) -> str:
    """The id of a page's response, to which revisits refer."""
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:x-page:{page_id}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, level: int = 6) -> bytes:
    """One record as a gzip member of its own."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id if refers_to is None else None)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _safe(url)),
        ("WARC-Profile", None if refers_to is None else _PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("WARC-Page-ID", None if page_id is None else str(page_id)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _members(stream):
    """The content of each gzip member, as an iterator of pieces."""
    held = stream.read(_PIECE)
    while held:
        unpack = zlib.decompressobj(31)

        def pieces():
            nonlocal held
            while not unpack.eof:
                if not held:
                    held = stream.read(_PIECE)
                    if not held:
                        raise WarcError("the archive ends inside a record")
                try:
                    out = unpack.decompress(held, _PIECE * 16)
                except zlib.error as e:
                    raise WarcError(f"not a gzip member: {e}") from e
                held = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
                if out:
                    yield out

        yield pieces()
        while not unpack.eof:
            raise WarcError("a record was not read to its end")
        held = held or stream.read(_PIECE)


def read_records(stream):
    """(fields, payload) of each record, in order; raises WarcError."""
    for pieces in _members(stream):
        head = bytearray()
        end = -1
        for piece in pieces:
            head += piece
            if (end := head.find(b"\r\n\r\n")) >= 0:
                break
        if end < 0:
            raise WarcError("a record without a header's end")
        lines = head[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise WarcError("a record without a version line")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a length") from e
        rest, digest = head[end + 4 :], hashlib.sha1()
        block, seen = [], 0

        def take(piece: bytes) -> bytes:
            nonlocal seen
            own = bytes(piece[: max(0, length - seen)])
            seen += len(own)
            digest.update(own)
            block.append(own)
            return bytes(piece[len(own) :])

        tail = take(rest)
        for piece in pieces:
            tail += take(piece)
        if seen != length or tail != b"\r\n\r\n":
            raise WarcError("a record's content differs from its length")
        named = fields.get("warc-block-digest", "").removeprefix("sha1:")
        if named and named != base64.b32encode(digest.digest()).decode():
            raise WarcError("a block fails its digest")
        content = b"".join(block)
        cut = content.find(b"\r\n\r\n")
        payload = content[cut + 4 :] if cut >= 0 else content
        named = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if named and fields.get("warc-type") == "response" and named != base32_sha1(payload):
            raise WarcError("a payload fails its digest")
        yield fields, payload


def _open(uri: str, write: bool):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if write:
        where.create_dir(os.path.dirname(path), recursive=True)
        return where.open_output_stream(path)
    return where.open_input_stream(path)


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, refers_to); only narrow rows are aggregated."""
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).withColumn("payload_key", F.unhex(F.sha2(F.col("html").cast("binary"), 256)))
    first = saved(keyed.groupBy(F.col("payload_key").alias("key")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "warc-payloads")
    most = max(1, (first.agg(F.sum("n")).first()[0] or 0) // _HOT)
    hot = first.where(F.col("n") > most).select(F.col("key").alias("hot_key"), F.col("first_id").alias("hot_id"))
    rest = first.where(F.col("n").between(2, most)).select(F.col("key").alias("rest_key"), F.col("first_id").alias("rest_id"))
    rows = keyed.join(F.broadcast(hot), F.col("payload_key") == F.col("hot_key"), "left")
    # Pages already served get keys of their own, which spread.
    key = F.when(F.col("hot_key").isNull(), F.col("payload_key")).otherwise(F.concat(F.lit("page ").cast("binary"), F.coalesce(F.col("page_id"), F.lit(0)).cast("string").cast("binary")))
    rows = rows.withColumn("payload_key", key).join(rest, F.col("payload_key") == F.col("rest_key"), "left")
    first_id = F.coalesce("hot_id", "rest_id")
    return rows.select("page_id", "url", "html", F.when(first_id.eqNullSafe(F.col("page_id")), None).otherwise(first_id).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes archives; gives their list (path, n_records), saved."""
    ship(pages.sparkSession)

    @tidy
    def run(batches):
        context, stream, path, size, count = TaskContext.get(), None, "", 0, 0
        for batch in batches:
            for a, b in by_bytes(sizes_of(batch.column("html"))):
                part = batch.slice(a, b - a)
                html = part.column("html")
                rows = zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "refers_to")))
                for i, (page_id, url, refers_to) in enumerate(rows):
                    if stream is None:
                        path, size, count = f"{folder}/part-{context.partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                        stream = _open(path, True)
                    record = make_record(page_id, url, html[i].as_buffer().to_pybytes(), refers_to, date)
                    stream.write(record)
                    size, count = size + len(record), count + 1
                    if size >= archive_bytes:
                        stream.close()
                        stream = None
                        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count]})

    # The list has a row for each archive: a few files hold it.
    return saved(mark_revisits(pages).mapInArrow(run, "path string, n_records bigint").repartition(4), "warc-list")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record: its fields, payload bytes and digest."""
    ship(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def row(fields: dict, payload: bytes) -> tuple:
        number = lambda x: int(x) if x is not None else None
        refers = fields.get("warc-refers-to")
        whole = fields["warc-type"] == "response"
        return (
            number(fields.get("warc-page-id")),
            fields.get("warc-target-uri"),
            len(payload) if whole else number(fields.get("warc-payload-length")),
            base32_sha1(payload) if whole else fields["warc-payload-digest"].removeprefix("sha1:"),
            fields["warc-type"],
            number(refers[len("<urn:x-page:") : -1]) if refers else None,
        )

    @tidy
    def run(batches):
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                held, count = [], 0
                with _open(path, False) as stream:
                    for fields, payload in read_records(stream):
                        held.append(row(fields, payload))
                        count += 1
                        if len(held) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                            held = []
                if count != n:
                    raise WarcError(f"{path} has {count} records, not {n}")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    spark = archives.sparkSession
    parts = max(1, min(archives.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return archives.select("path", "n_records").repartition(parts).mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads them back."""
    folder = scratch(pages.sparkSession, "warc")
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder[len("file:") :]
    return read_archives(write_archives(pages, folder))
