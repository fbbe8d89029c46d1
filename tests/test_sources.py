import gzip
import struct
import sys

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from readloom.functions.flags import FormatError
from readloom.sources import bam, files, header, sam, write
from readloom.streaming import flows

HEAD = "@HD\tVN:1.0\tSO:coordinate\n@SQ\tSN:1\tLN:249250621\n@SQ\tSN:MT\tLN:16569\n@RG\tID:a\tLB:x\n@RG\tID:b\n@CO\tany text: here\n"
LINES = [
    "foo\t37\t*\t0\t0\t*\t*\t0\t0\tATGC\t????\tNM:i:4",
    "r1\t99\t1\t100\t60\t4M\t=\t200\t104\tACGT\tIIII\tRG:Z:a\tXI:i:-70000\tXF:f:1.5\tXB:B:c,1,-2,3\tXH:H:1AE3",
    "r1\t147\t1\t200\t60\t2S2M\t=\t100\t-104\tACGT\t*\tRG:Z:a\tXA:A:+",
    "r2\t0\tMT\t1\t255\t4M5000N1M\t1\t7\t0\tNNNNN\t!!!~~\tRG:Z:b\tXI:i:4000000000",
    "r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*",
]


@pytest.fixture(scope="module")
def sam_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("sam") / "x.any"
    path.write_text(HEAD + "\n".join(LINES))
    return str(path)


def lines_of(path):
    text = gzip.open(path, "rt").read() if path.endswith("gz") else open(path).read()
    return [x for x in text.split("\n") if x and x[0] != "@"], "".join(x + "\n" for x in text.split("\n") if x[:1] == "@")


@pytest.mark.parametrize("split_bytes", [1 << 20, 40, 7])
def test_sam_round_trip(spark, sam_file, tmp_path, split_bytes):
    rows = sam.read_alignments(spark, sam_file, split_bytes=split_bytes)
    assert rows.count() == len(LINES)
    out = write.write_alignments(rows.orderBy("ordinal"), sam.read_header(sam_file), str(tmp_path / "y.sam"))[0]
    assert lines_of(out[7:]) == (LINES, HEAD)


@pytest.mark.parametrize("format", ["bam", "ubam", "sam.gz"])
def test_other_formats(spark, sam_file, tmp_path, format):
    catalog = sam.read_header(sam_file)
    rows = sam.read_alignments(spark, sam_file).orderBy("ordinal")
    path = write.write_alignments(rows, catalog, str(tmp_path / "name.none"), format)[0]
    assert files.sniff(path) == ("gzip" if format == "sam.gz" else "bam")
    assert sam.read_header(path).text() == HEAD
    back = write.write_alignments(sam.read_alignments(spark, path).orderBy("ordinal"), catalog, str(tmp_path / "z.sam"))[0]
    assert lines_of(back[7:])[0] == LINES


def test_flag_styles_and_parts(spark, sam_file, tmp_path):
    catalog, rows = sam.read_header(sam_file), sam.read_alignments(spark, sam_file)
    assert lines_of(write.write_alignments(rows.orderBy("ordinal"), catalog, str(tmp_path / "h"), "hex", header=False)[0][7:])[0][1].split("\t")[1] == "0x63"
    text = write.write_alignments(rows.orderBy("ordinal"), catalog, str(tmp_path / "t"), "text")[0]
    assert lines_of(text[7:])[0][1].split("\t")[1] == "fRpP1"
    with pytest.raises(PySparkException):
        sam.read_alignments(spark, str(tmp_path / "bad")).count() if (tmp_path / "bad").write_text("x") else None
    parts = write.write_alignments(rows.repartition(3), catalog, str(tmp_path / "parts"), "bam", parts=True)
    assert len(parts) == 3 and sam.read_alignments(spark, *parts).count() == len(LINES)
    with pytest.raises(ValueError):
        write.write_alignments(rows, catalog, "x", "cram")


@pytest.mark.parametrize(
    "line",
    ["a\t0\t*\t0\t0\t*\t*\t0\t0\t*", "a\t0\t*\t0\t0\t*\t*\t0\t0\tAC\tI", "a\t0\t*\t0\t0\t*\t*\t0\t0\t*\tI", "a\t0\tq\t0\t0\t*\t*\t0\t0\t*\t*", "a\t0\t*\t0\t0\tM\t*\t0\t0\t*\t*",
     "a\t0\t*\t0\t256\t*\t*\t0\t0\t*\t*", "a\t0\t*\tx\t0\t*\t*\t0\t0\t*\t*", "a\tz\t*\t0\t0\t*\t*\t0\t0\t*\t*", "a\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\tNM:i:x", ""],
)
def test_malformed_lines_raise(spark, tmp_path, line):
    path = tmp_path / "m.sam"
    path.write_text(f"@SQ\tSN:1\tLN:5\n{line}\n")
    with pytest.raises(PySparkException):
        sam.read_alignments(spark, str(path)).collect()


def test_line_ends_and_empty_numbers(spark, tmp_path):
    path = tmp_path / "c.sam"
    path.write_bytes(b"@SQ\tSN:1\tLN:5\r\na\tu1\t1\t\t0\t*\t*\t0\t0\t*\t*\r\nb\t0x4\t*\t0\t0\t*\t*\t0\t0\ta.\tII")
    rows = sam.read_alignments(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.qname, r.flag, r.pos, r.zpos, r.seq) for r in rows] == [("a", 68, 0, -1, ""), ("b", 4, 0, -1, "AN")]
    (tmp_path / "e.sam").write_text("")
    assert sam.read_alignments(spark, str(tmp_path / "e.sam")).count() == 0


@pytest.mark.parametrize("split_bytes", [1 << 20, 9])
def test_records_may_begin_with_the_header_sign(spark, tmp_path, split_bytes):
    path = tmp_path / "at.sam"
    rest = "\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"
    path.write_text("@HD\tVN:1.0\n@SQ\tSN:1\tLN:5\nr1" + rest + "@r2" + rest + "r3" + rest)
    (tmp_path / "at.gz").write_bytes(gzip.compress(path.read_bytes()))
    for p in (path, tmp_path / "at.gz"):
        assert [r.qname for r in sam.read_alignments(spark, str(p), split_bytes=split_bytes).orderBy("ordinal").collect()] == ["r1", "@r2", "r3"]


def test_malformed_records_are_dropped_on_request(spark, tmp_path):
    good = ["ok%d\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*" % i for i in range(2)]
    bad = ["a\tz\t*\t0\t0\t*\t*\t0\t0\t*\t*", "a\t0\tq\t0\t0\t*\t*\t0\t0\t*\t*", "a\t0\t*\t0\t256\t*\t*\t0\t0\t*\t*", "a\t0\t*\t0\t0\tM\t*\t0\t0\t*\t*", "a\t0\t*\tx\t0\t*\t*\t0\t0\t*\t*", "a\t0\t*\t0\t0\t*\t*\t0\t0\t*\t*\tNM:i:x", "short"]
    path = tmp_path / "d.sam"
    path.write_bytes("\n".join([good[0], *bad]).encode() + b"\n\xff\xfe" + good[1].encode() + b"\n" + good[1].encode() + b"\n")
    assert sorted(r.qname for r in sam.read_alignments(spark, str(path), mode="DROPMALFORMED").collect()) == ["ok0", "ok1"]
    with pytest.raises(PySparkException):
        sam.read_alignments(spark, str(path)).collect()


def test_a_bad_file_is_noted_and_the_next_is_read(spark, sam_file, tmp_path):
    (tmp_path / "cram").write_bytes(b"CRAM\2" + bytes(20))
    bad = []
    rows = sam.read_alignments(spark, str(tmp_path / "none"), str(tmp_path / "cram"), sam_file, bad_files=bad)
    assert rows.count() == len(LINES) and [p.rsplit("/", 1)[1] for p, _ in bad] == ["none", "cram"]
    with pytest.raises(OSError):
        sam.read_alignments(spark, str(tmp_path / "none"))


def test_standard_input_and_output(spark, sam_file, monkeypatch, capfdbinary):
    monkeypatch.setattr(sys, "stdin", open(sam_file))
    rows = sam.read_alignments(spark, "-")
    assert rows.count() == len(LINES)
    assert write.write_alignments(rows.orderBy("ordinal"), sam.read_header(sam_file), "-") == ["-"]
    assert capfdbinary.readouterr().out.decode().endswith(LINES[-1] + "\n")


def test_the_first_or_the_last_line_of_a_group_counts(spark):
    from readloom.operators import reads, split

    rows = spark.createDataFrame([(1, "a", 0, 60)], "ord bigint, rg string, flag int, mapq int")
    groups = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("a", "z", 3)], "id string, lb string, line_no int")
    assert reads.lookup_group(rows, groups).first().rg_lb == "z" and split.route(rows, groups).first().rg_lb == "y"
    with pytest.raises(PySparkException):
        reads.lookup_group(rows, groups.drop("line_no")).collect()


def test_damaged_bam(spark, sam_file, tmp_path):
    catalog = sam.read_header(sam_file)
    whole = open(write.write_alignments(sam.read_alignments(spark, sam_file), catalog, str(tmp_path / "g.bam"), "bam")[0][7:], "rb").read()
    assert whole.endswith(bam.END_BLOCK)
    for name, data in (("cut", whole[: len(whole) // 2]), ("crc", whole[:40] + bytes([whole[40] ^ 1]) + whole[41:]), ("magic", bam.make_block(b"BAX\1" + bytes(8)) + bam.END_BLOCK)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises((FormatError, PySparkException)):
            bam.read_header(str(tmp_path / name)), bam.read_records(spark, str(tmp_path / name)).count()
    (tmp_path / "cram").write_bytes(b"CRAM\2" + bytes(20))
    with pytest.raises(files.UnsupportedFormat):
        files.sniff(str(tmp_path / "cram"))
    # References of the binary list alone; empty blocks between others.
    body = b"BAM\1" + struct.pack("<ii", 0, 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 99)
    (tmp_path / "n.bam").write_bytes(bam.make_block(body[:9]) + bam.make_block(b"") + bam.make_block(body[9:]) + bam.END_BLOCK)
    assert bam.read_header(str(tmp_path / "n.bam")).references == [("1", 99)]


def test_large_headers(spark, tmp_path):
    many = header.HeaderCatalog([f"@SQ\tSN:chr{i}\tLN:{10000 + 2 * i}" for i in range(20_000)])
    huge = header.HeaderCatalog([f"@SQ\tSN:chr{i}\tLN:{10000 + 2 * i}" for i in range(1200)] + ["@SQ\tSN:chrBig\tLN:80000\tSP:" + "A" * 80_000])
    for i, catalog in enumerate((many, huge)):
        with files.open_file(str(tmp_path / f"{i}.bam"), write=True) as f:
            bam.BamWriter(f, catalog).close()
        assert sam.read_header(str(tmp_path / f"{i}.bam")).text() == catalog.text()


def test_header_catalog(spark):
    c = header.HeaderCatalog(HEAD.splitlines())
    assert c.text() == HEAD and c.find_reference("MT") == ("MT", 16569) and c.find_reference(-1) == ("*", 0) and c.find_reference(0)[0] == "1"
    assert c.find_group("a").get("LB") == "x" and c.of_type("SQ")[0].get_int("LN") == 249250621
    c.mark_query_grouped()
    assert str(c.headers[0]) == "@HD\tVN:1.0\tGO:query"
    c.headers[0].set("VN", "1.4")
    assert c.headers[0].erase("GO") == 1 and str(c.headers[0]) == "@HD\tVN:1.4"
    for bad in (lambda: c.find_reference("x"), lambda: c.find_group("z"), lambda: c.headers[0].get("QQ"), lambda: header.Header.parse("SQ"), lambda: header.HeaderCatalog(["@SQ\tSN:1\tLN:1"] * 2)):
        with pytest.raises((FormatError, KeyError)):
            bad()
    assert [tuple(r)[:3] for r in c.references_frame(spark).orderBy("rindex").collect()] == [(0, "1", 249250621), (1, "MT", 16569)]
    merged = header.merge_catalogs(c, header.HeaderCatalog(["@HD\tVN:9", "@SQ\tSN:MT\tLN:16569", "@SQ\tSN:2\tLN:7", "@RG\tID:c"]))
    assert [n for n, _ in merged.references] == ["1", "MT", "2"] and list(merged.groups) == ["a", "b", "c"] and len(merged.of_type("HD")) == 1
    with pytest.raises(FormatError):
        header.merge_catalogs(c, header.HeaderCatalog(["@SQ\tSN:MT\tLN:1"]))
    assert c.headers_frame(spark).where("type = 'RG'").count() == 2


def test_split(spark, sam_file, tmp_path):
    text = HEAD + "@RG\tID:none\n" + "\n".join(LINES[1:4]) + "\n"
    (tmp_path / "s.sam").write_text(text)
    path = str(tmp_path / "s.sam")
    rows, catalog = sam.read_alignments(spark, path), sam.read_header(path)
    out = write.split_by_group(rows.orderBy("ordinal"), catalog, path, str(tmp_path / "o"), copy_to=str(tmp_path / "all.sam"))
    assert {g: len(lines_of(p[7:])[0]) for g, p in out.items()} == {"a": 2, "b": 1, "none": 0}
    assert all(lines_of(p[7:])[1] == catalog.text() for p in out.values()) and out["a"].endswith("/o/s-a.sam")
    assert lines_of(str(tmp_path / "all.sam"))[0] == LINES[1:4]
    with pytest.raises(PySparkException):
        write.split_by_group(sam.read_alignments(spark, sam_file), sam.read_header(sam_file), sam_file, str(tmp_path / "p"))
    assert write.heads(path, sam_file).startswith(f"==> {path} <==\n@HD") and write.heads(path) == catalog.text()


def test_streams(spark, tmp_path):
    rows = [(i, f"n{i % 7}", 64 if i % 2 else 4, f"g{i % 2}") for i in range(20)]
    schema = "ord bigint, qname string, flag int, rg string"
    for k in range(2):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert len(run(flows.stream_filter(source().withColumn("mapq", F.lit(0)), "-u"), "kept", "append")) == 10
    assert {(r.readgroup, r.mapped, r.unmapped) for r in run(flows.stream_counts(source()), "counts", "complete")} == {("g0", 0, 10), ("g1", 10, 0)}
    flows.stream_split(source(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("split_rg").count().count() == 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pairs = run(flows.stream_pairs(source()), "pairs", "append")
    assert {(r.qname, r.first_ord, r.second_ord) for r in pairs} == {(f"n{i}", i, i + 7) for i in range(7)}
