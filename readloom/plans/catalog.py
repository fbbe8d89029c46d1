"""Registered queries of the alignment operators, and their SQL.

The tables hold no alignments, so the operators run over alignment-shaped views
of them (``views``). Cigar strings are parsed here and known there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import aux, cigar, flags, intervals, seq
from readloom.operators import export, ordering, overlap, pairing, reads, split
from readloom.plans import views

QUERIES: dict = {}
ORACLES: dict = {}


def _query(select: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLES[f.__name__] = views.oracle(select)
        return f

    return register


def _aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads with their span, as the operators compute it."""
    rows = views.spark_view(spark, sf_dir, views.ALN).drop("ref_len")
    return rows.withColumn("span", cigar.cigar_span(F.col("flag"), cigar.cigar_ops(F.col("cigar"))))


def _rgh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spark_view(spark, sf_dir, views.RGH)


def _feat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.spark_view(spark, sf_dir, views.FEAT)


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("rindex"), F.col("n_name").alias("name"))


@_query("SELECT ord, qname, flag FROM aln WHERE (flag & 3) = 3 AND (flag & 16) = 0")
def flag_filter(spark, sf_dir):
    return reads.filter_reads(_aln(spark, sf_dir), "+3-16").select("ord", "qname", "flag")


@_query("SELECT ord, qname, flag, mapq FROM aln WHERE (flag & 1) = 1 AND (flag & 1028) = 0 AND mapq >= 20")
def flag_mapq_filter(spark, sf_dir):
    return reads.filter_reads(_aln(spark, sf_dir), "+p", "-ud", min_quality=20).select("ord", "qname", "flag", "mapq")


@_query("SELECT CAST(count(*) AS bigint) AS n_in, CAST(count(*) FILTER (WHERE (flag & 3) = 3 AND (flag & 16) = 0) AS bigint) AS n_out FROM aln")
def filter_statistics(spark, sf_dir):
    return reads.filter_statistics(_aln(spark, sf_dir), "+3-16")


_TEXT = """(CASE WHEN flag&4<>0 THEN 'u' ELSE '' END) || (CASE WHEN flag&16<>0 THEN 'r' WHEN flag&4=0 THEN 'f' ELSE '' END)
 || (CASE WHEN flag&8<>0 THEN 'U' ELSE '' END) || (CASE WHEN flag&32<>0 THEN 'R' WHEN flag&9=1 THEN 'F' ELSE '' END)
 || (CASE WHEN flag&1<>0 THEN 'p' ELSE '' END) || (CASE WHEN flag&2<>0 THEN 'P' ELSE '' END) || (CASE WHEN flag&64<>0 THEN '1' ELSE '' END)
 || (CASE WHEN flag&128<>0 THEN '2' ELSE '' END) || (CASE WHEN flag&256<>0 THEN 's' ELSE '' END) || (CASE WHEN flag&2048<>0 THEN 'S' ELSE '' END)
 || (CASE WHEN flag&512<>0 THEN 'x' ELSE '' END) || (CASE WHEN flag&1024<>0 THEN 'd' ELSE '' END)"""


def _bits(text: str) -> str:
    """DuckDB's precedence of & differs; brackets settle it."""
    import re

    return re.sub(r"flag&(\d+)", r"(flag & \1)", text)


@_query(
    f"""SELECT ord, CAST(flag AS string) AS flag_dec, CASE WHEN flag = 0 THEN '0' ELSE '0' || to_base(flag, 8) END AS flag_oct,
 CASE WHEN flag = 0 THEN '0' ELSE '0x' || upper(to_base(flag, 16)) END AS flag_hex, {_bits(_TEXT)} AS flag_text FROM aln"""
)
def flag_text(spark, sf_dir):
    flag = F.col("flag")
    styles = {f"flag_{s}": flags.format_flags(flag, s) for s in ("dec", "oct", "hex", "text")}
    return _aln(spark, sf_dir).select("ord", *[c.alias(n) for n, c in styles.items()])


@_query("SELECT ord, flag AS from_dec, flag AS from_oct, flag AS from_hex, flag AS from_text FROM aln")
def flag_parse_roundtrip(spark, sf_dir):
    # A text that begins with a digit would be a number; the neutral underscore keeps letters letters.
    texts = {s: flags.format_flags(F.col("flag"), s) for s in ("dec", "oct", "hex")} | {"text": F.concat(F.lit("_"), flags.flag_text(F.col("flag")))}
    return _aln(spark, sf_dir).select("ord", *[flags.parse_flags_column(t).alias(f"from_{s}") for s, t in texts.items()])


@_query(
    """SELECT ord, CASE WHEN (flag & 16) <> 0 THEN -1 ELSE 1 END AS strand, CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END AS strand_char,
 CASE WHEN (flag & 32) <> 0 THEN -1 ELSE 1 END AS mate_strand, CASE WHEN (flag & 32) <> 0 THEN '-' ELSE '+' END AS mate_strand_char,
 CASE (flag & 192) WHEN 64 THEN -1 WHEN 128 THEN 1 ELSE 0 END AS pair_order FROM aln"""
)
def strand_order(spark, sf_dir):
    f = F.col("flag")
    return _aln(spark, sf_dir).select(
        "ord", flags.strand(f).alias("strand"), flags.strand_char(f).alias("strand_char"), flags.mate_strand(f).alias("mate_strand"),
        flags.mate_strand_char(f).alias("mate_strand_char"), flags.order(f).alias("pair_order"),
    )


@_query("SELECT ord, cigar, span FROM sp")
def cigar_span(spark, sf_dir):
    return _aln(spark, sf_dir).select("ord", "cigar", "span")


@_query(
    """SELECT ord, CAST(i - 1 AS int) AS op_no, CAST(regexp_extract(x, '[0-9]+') AS bigint) AS len, right(x, 1) AS op,
 right(x, 1) IN ('M','I','S','=','X') AS uses_query, right(x, 1) IN ('M','D','N','=','X') AS uses_reference
 FROM (SELECT ord, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT ord, regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]') AS l FROM aln) AS a) AS b"""
)
def cigar_ops_exploded(spark, sf_dir):
    rows = _aln(spark, sf_dir).select("ord", F.posexplode(cigar.cigar_ops(F.col("cigar"))).alias("op_no", "x"))
    op = F.col("x.op")
    return rows.select("ord", "op_no", "x.len", "x.op", cigar.consumes_query(op).alias("uses_query"), cigar.consumes_reference(op).alias("uses_reference"))


@_query(
    """SELECT ord, zpos + 1 AS pos, zpos + span AS right_pos, CAST(CASE WHEN zpos>>14 = (zpos+span-1)>>14 THEN (zpos>>14) + 4681
 WHEN zpos>>17 = (zpos+span-1)>>17 THEN (zpos>>17) + 585 WHEN zpos>>20 = (zpos+span-1)>>20 THEN (zpos>>20) + 73
 WHEN zpos>>23 = (zpos+span-1)>>23 THEN (zpos>>23) + 9 WHEN zpos>>26 = (zpos+span-1)>>26 THEN (zpos>>26) + 1 ELSE 0 END AS int) AS bin
 FROM sp WHERE zpos >= 0"""
)
def right_pos_bin(spark, sf_dir):
    right = cigar.right_pos(F.col("zpos"), F.col("span"))
    rows = _aln(spark, sf_dir).where("zpos >= 0")
    return rows.select("ord", (F.col("zpos") + 1).alias("pos"), (right + 1).alias("right_pos"), cigar.zbin(F.col("zpos"), right).alias("bin"))


@_query(
    """SELECT ord, zpos, span FROM sp WHERE rindex = 7 AND zpos < 90000000 AND zpos + span > 30000000"""
)
def region_reads(spark, sf_dir):
    rows = _aln(spark, sf_dir).withColumn("bin", cigar.zbin(F.col("zpos"), F.col("zpos") + F.col("span") - 1))
    return overlap.region(rows, 7, 30_000_000, 90_000_000).select("ord", "zpos", "span")


@_query(
    """SELECT coalesce(rg, '(ungrouped)') AS readgroup, CAST(count(*) FILTER (WHERE (flag & 4) = 0) AS bigint) AS mapped,
 CAST(count(*) FILTER (WHERE (flag & 4) <> 0) AS bigint) AS unmapped FROM aln GROUP BY 1"""
)
def rg_counts(spark, sf_dir):
    return reads.count_by_group(_aln(spark, sf_dir)).select("readgroup", "mapped", "unmapped")


_LIBRARIES = """SELECT lb AS library, CAST(coalesce(sum(m), 0) AS bigint) AS mapped, CAST(coalesce(sum(u), 0) AS bigint) AS unmapped FROM rgh LEFT JOIN
 (SELECT rg, count(*) FILTER (WHERE (flag & 4) = 0) AS m, count(*) FILTER (WHERE (flag & 4) <> 0) AS u FROM aln WHERE rg IS NOT NULL GROUP BY rg) AS c ON id = rg GROUP BY lb"""


@_query(_LIBRARIES)
def library_counts(spark, sf_dir):
    return reads.count_by_library(_aln(spark, sf_dir), _rgh(spark, sf_dir)).select("library", "mapped", "unmapped")


@_query("SELECT ord, rindex, CASE WHEN rindex < 0 THEN '*' ELSE n_name END AS rname FROM aln LEFT JOIN nation ON rindex = n_nationkey")
def ref_lookup(spark, sf_dir):
    return reads.lookup_reference(_aln(spark, sf_dir), _references(spark, sf_dir)).select("ord", "rindex", "rname")


_PAIRS = """SELECT ord, qname, rn, (rn - 1) // 2 AS pair_no, count(*) OVER (PARTITION BY qname, (rn - 1) // 2) = 1 AS single,
 CASE WHEN count(*) OVER (PARTITION BY qname, (rn - 1) // 2) = 2 THEN max(ord) OVER (PARTITION BY qname, (rn - 1) // 2) END AS close_ord
 FROM (SELECT ord, qname, row_number() OVER (PARTITION BY qname ORDER BY ord) AS rn FROM aln) AS a"""


@_query(f"SELECT *, row_number() OVER (ORDER BY single, coalesce(close_ord, 0), CASE WHEN single THEN qname ELSE '' END, rn) AS emit_rank FROM ({_PAIRS}) AS p")
def pairs_by_name(spark, sf_dir):
    paired = pairing.pair_by_name(_aln(spark, sf_dir).select("ord", "qname"))
    return pairing.emission_rank(paired).select("ord", "qname", "rn", "pair_no", "single", "close_ord", "emit_rank")


@_query(
    """SELECT CAST(count(*) FILTER (WHERE rn % 2 = 0) AS bigint) AS pairs, CAST(count(*) - 2 * count(*) FILTER (WHERE rn % 2 = 0) AS bigint) AS singletons,
 CAST(coalesce(max(s + 1) FILTER (WHERE rn % 2 = 0), 0) AS bigint) AS max_pending FROM (SELECT rn, sum(CASE WHEN rn % 2 = 1 THEN 1 ELSE -1 END) OVER (ORDER BY ord) AS s
 FROM (SELECT ord, row_number() OVER (PARTITION BY qname ORDER BY ord) AS rn FROM aln) AS a) AS b"""
)
def pair_stats(spark, sf_dir):
    return pairing.pair_statistics(_aln(spark, sf_dir))


@_query(f"SELECT ord, qname, pair_no FROM ({_PAIRS}) AS p WHERE NOT single")
def pairs_only(spark, sf_dir):
    return pairing.pair_by_name(_aln(spark, sf_dir).select("ord", "qname"), pairs_only=True).select("ord", "qname", "pair_no")


@_query(f"SELECT ord, qname FROM ({_PAIRS}) AS p WHERE single")
def singletons(spark, sf_dir):
    return pairing.pair_by_name(_aln(spark, sf_dir).select("ord", "qname")).where("single").select("ord", "qname")


_LOCATION = "CASE WHEN rindex < 0 THEN 4294967295 ELSE rindex END, zpos, qname, CASE (flag & 192) WHEN 64 THEN -1 WHEN 128 THEN 1 ELSE 0 END"


@_query(f"SELECT ord, row_number() OVER (ORDER BY {_LOCATION}, ord) AS rank FROM aln")
def sort_location_rank(spark, sf_dir):
    return ordering.sort_rank(_aln(spark, sf_dir), "location", "ord").select("ord", "rank")


@_query("SELECT ord, row_number() OVER (ORDER BY qname, CASE (flag & 192) WHEN 64 THEN -1 WHEN 128 THEN 1 ELSE 0 END, ord) AS rank FROM aln")
def sort_qname_rank(spark, sf_dir):
    return ordering.sort_rank(_aln(spark, sf_dir), "qname", "ord").select("ord", "rank")


@_query(
    """SELECT CAST(count(*) AS bigint) AS n_rows, CAST(count(*) FILTER (WHERE k < p) AS bigint) AS n_inversions FROM
 (SELECT k, lag(k) OVER (ORDER BY ord) AS p FROM (SELECT ord, struct_pack(a := qname, b := CASE (flag & 192) WHEN 64 THEN -1 WHEN 128 THEN 1 ELSE 0 END) AS k FROM aln) AS x) AS y"""
)
def check_sorted(spark, sf_dir):
    return ordering.check_sorted(_aln(spark, sf_dir), "qname")


@_query(f"SELECT ord, CAST(ord % 2 AS int) AS source, row_number() OVER (ORDER BY {_LOCATION}, ord % 2, ord) AS rank FROM aln")
def merge_sorted(spark, sf_dir):
    rows = _aln(spark, sf_dir)
    parts = [rows.where(F.col("ord") % 2 == i) for i in (0, 1)]
    return ordering.merge_sorted(*parts, by="location", ties=("ord",)).select("ord", "source", "rank")


@_query("SELECT ord, qname, 0 AS source FROM aln UNION ALL SELECT event_id AS ord, 'u' || CAST(user_id AS string) AS qname, 1 AS source FROM events")
def concat_sources(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    second = events.select(F.col("event_id").alias("ord"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("qname"))
    return reads.concat(_aln(spark, sf_dir).select("ord", "qname"), second)


@_query("SELECT id, CAST(count(rg) AS bigint) AS n_reads FROM (SELECT DISTINCT id FROM rgh) AS h LEFT JOIN aln ON id = rg AND (flag & 4) = 0 AND mapq >= 10 GROUP BY id")
def split_counts(spark, sf_dir):
    return split.split_counts(_aln(spark, sf_dir), _rgh(spark, sf_dir), "-u", min_quality=10)


@_query(
    """SELECT ord, coalesce(rg, 'none') AS rg_id, CASE coalesce(rg, 'none') WHEN '5-LOW' THEN 'libD' WHEN 'none' THEN 'first' ELSE lb END AS rg_lb
 FROM aln LEFT JOIN rgh ON rg = id WHERE (flag & 4) = 0"""
)
def split_route(spark, sf_dir):
    # A header with every group that occurs; of lines that repeat an id the first counts.
    more = spark.createDataFrame([("5-LOW", "libD", 5), ("none", "first", 6), ("none", "second", 7)], "id string, lb string, line_no int")
    groups = _rgh(spark, sf_dir).withColumn("line_no", F.lit(0)).unionByName(more)
    return split.route(_aln(spark, sf_dir).fillna("none", ["rg"]), groups, "-u").select("ord", "rg_id", "rg_lb")


@_query("SELECT id, '100%_run1-' || id || '_' || CAST(row_number() OVER (ORDER BY id) AS string) || '.bam' AS name FROM rgh")
def split_names(spark, sf_dir):
    from pyspark.sql import Window

    groups = _rgh(spark, sf_dir).withColumn("number", F.row_number().over(Window.orderBy("id")))  # a header's few rows
    name = split.expand_column("100%%_%*-%ID_%#.%.", {"ID": F.col("id")}, F.col("number"), "/data/run1.x.bam", "bam")
    return groups.select("id", name.alias("name"))


_OVERLAP = "sp.rindex = feat.rindex AND sp.zpos < feat.zlimit AND feat.zstart < sp.zpos + sp.span"


def _hits(spark, sf_dir) -> DataFrame:
    own = overlap.read_intervals(_aln(spark, sf_dir)).select("ord", "rindex", "zstart", "zlimit")
    return overlap.overlap_join(own, _feat(spark, sf_dir), "rindex")


@_query(f"SELECT ord, feat_id FROM sp JOIN feat ON {_OVERLAP}")
def overlap_join(spark, sf_dir):
    return _hits(spark, sf_dir).select("ord", F.col("r_feat_id").alias("feat_id"))


@_query(f"SELECT ord, CAST(count(*) AS bigint) AS n_features, CAST(min(feat_id) AS bigint) AS first_feature FROM sp JOIN feat ON {_OVERLAP} GROUP BY ord")
def overlap_per_read(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("ord").agg(F.count(F.lit(1)).alias("n_features"), F.min("r_feat_id").alias("first_feature"))


_SHAPES = """CASE p_partkey%6 WHEN 0 THEN '{s}' WHEN 1 THEN '{s}-{e}' WHEN 2 THEN '{s}+{n}' WHEN 3 THEN '-{e}' WHEN 4 THEN '{s}-' ELSE '+{n}' END"""


@_query(
    """SELECT p_partkey, 'Chr:' || CAST(p_partkey%25 AS string) AS name,
 CAST(CASE WHEN p_partkey%6 IN (3, 5) THEN 0 ELSE p_partkey*10 - 1 END AS bigint) AS zstart,
 CAST(CASE p_partkey%6 WHEN 0 THEN p_partkey*10 WHEN 1 THEN p_partkey*10 + 2000 WHEN 2 THEN p_partkey*10 - 1 + p_size WHEN 3 THEN p_partkey*10 + 2000
 WHEN 4 THEN 2147483647 ELSE p_size END AS bigint) AS zlimit FROM part"""
)
def interval_parse(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    start, end, size = F.format_number(F.col("p_partkey") * 10, 0), (F.col("p_partkey") * 10 + 2000).cast("string"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, start).when(kind == 1, F.concat(start, F.lit("-"), end)).when(kind == 2, F.concat(start, F.lit("+"), size))
        .when(kind == 3, F.concat(F.lit("-"), end)).when(kind == 4, F.concat(start, F.lit("-"))).otherwise(F.concat(F.lit("+"), size))
    )
    full = F.concat(F.lit("Chr:"), (F.col("p_partkey") % 25).cast("string"), F.lit(":"), text)
    return part.select("p_partkey", intervals.seqinterval_column(full).alias("i")).select("p_partkey", "i.name", "i.zstart", "i.zlimit")


@_query("SELECT feat_id, n_name || ':' || CAST(zstart + 1 AS string) || '-' || CAST(zlimit AS string) AS text FROM feat JOIN nation ON rindex = n_nationkey")
def interval_text(spark, sf_dir):
    named = reads.lookup_reference(_feat(spark, sf_dir), _references(spark, sf_dir))
    return named.select("feat_id", intervals.seqinterval_text(F.col("rname"), F.col("zstart"), F.col("zlimit")).alias("text"))


def _with_aux(spark, sf_dir) -> DataFrame:
    """Reads with auxiliary fields, parsed from text as a file would have them."""
    texts = F.array(
        F.concat(F.lit("NM:i:"), F.col("mapq").cast("string")),
        F.concat(F.lit("RG:Z:"), F.coalesce("rg", F.lit(""))),
        F.when(F.col("ord") % 3 == 0, F.concat(F.lit("XA:A:"), flags.strand_char(F.col("flag")))),
    )
    kept = F.filter(texts, lambda x: x.isNotNull() & (x != "RG:Z:"))
    return _aln(spark, sf_dir).withColumn("aux", aux.aux_parse(kept))


@_query(
    """SELECT ord, CAST(mapq AS bigint) AS nm, rg, CASE WHEN ord%3=0 THEN CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END ELSE '?' END AS xa,
 rg IS NOT NULL AS has_rg FROM aln"""
)
def aux_get(spark, sf_dir):
    rows, a = _with_aux(spark, sf_dir), F.col("aux")
    return rows.select("ord", aux.aux_int(a, "NM").alias("nm"), reads.read_group(rows).alias("rg"), aux.aux_char(a, "XA", F.lit("?")).alias("xa"), aux.aux_has(a, "RG").alias("has_rg"))


@_query(
    """SELECT ord, concat_ws(' ', 'NM:i:' || CAST(mapq + 1 AS string), CASE WHEN rg IS NOT NULL THEN 'RG:Z:' || rg END, 'XB:Z:new') AS fields,
 CAST(CASE WHEN ord%3=0 THEN 1 ELSE 0 END AS int) AS n_erased FROM aln"""
)
def aux_set_erase(spark, sf_dir):
    a = F.col("aux")
    changed = aux.aux_set(aux.aux_set(aux.aux_erase(a, "XA"), "NM", "i", aux.aux_int(a, "NM") + 1), "XB", "Z", F.lit("new"))
    return _with_aux(spark, sf_dir).select("ord", F.concat_ws(" ", aux.aux_text(changed)).alias("fields"), aux.aux_erased_count(a, "XA").alias("n_erased"))


@_query("SELECT n_nationkey AS line_no, CASE WHEN n_nationkey%5=0 THEN '@HD\tVN:1.0\tGO:query' ELSE '@SQ\tSN:' || n_name || '\tLN:1000' END AS text FROM nation")
def header_rewrite(spark, sf_dir):
    from readloom.sources.header import parse_header_column, query_grouped, header_text

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    line = F.when(F.col("n_nationkey") % 5 == 0, F.lit("@HD\tVN:1.0\tSO:coordinate")).otherwise(F.concat(F.lit("@SQ\tSN:"), F.col("n_name"), F.lit("\tLN:1000")))
    rows = nation.select(F.col("n_nationkey").alias("line_no"), parse_header_column(line).alias("h"))
    return rows.select("line_no", header_text(query_grouped(F.col("h"))).alias("text"))


_BASES = "translate(substr(o_orderpriority || o_orderstatus, 1, CAST(o_orderkey%9 AS int)), '12345-URGENTHIMDOSPCFLW ', 'ACGTNACGTNACGTMRSVTWYHK=')"


def _sequence():
    """A sequence of 0 to 8 letters for each order."""
    text = F.substring(F.concat("o_orderpriority", "o_orderstatus"), F.lit(1), (F.col("o_orderkey") % 9).cast("int"))
    return F.translate(text, "12345-URGENTHIMDOSPCFLW ", "ACGTNACGTNACGTMRSVTWYHK=")


@_query(f"SELECT o_orderkey, {_BASES} AS seq, CAST((length({_BASES}) + 1) // 2 AS int) AS n_bytes FROM orders")
def seq_unpack(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("s", _sequence())
    packed = orders.withColumn("packed", seq.pack_seq(F.col("s")))
    return packed.select("o_orderkey", seq.unpack_seq(F.col("packed"), F.length("s")).alias("seq"), F.octet_length("packed").alias("n_bytes"))


@_query(
    """SELECT o_orderkey, CAST(list_sum(list_transform(string_split(o_orderstatus || o_orderpriority, ''), lambda c: CASE WHEN c = ' ' THEN ascii('_') ELSE ascii(c) END - 33)) AS bigint) AS total,
 replace(o_orderstatus || o_orderpriority, ' ', '_') AS qual FROM orders"""
)
def qual_decode(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = F.replace(F.concat("o_orderstatus", "o_orderpriority"), F.lit(" "), F.lit("_"))
    rows = orders.select("o_orderkey", seq.qual_values(text).alias("v"))
    return rows.select("o_orderkey", F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), seq.qual_text(F.col("v")).alias("qual"))


def _full(spark, sf_dir) -> DataFrame:
    """Reads with all columns of a record."""
    rows = reads.lookup_reference(_with_aux(spark, sf_dir), _references(spark, sf_dir))
    rows = rows.withColumn("mate_rindex", F.when(F.col("ord") % 4 == 0, F.col("rindex")).when(F.col("ord") % 4 == 1, F.lit(-1)).otherwise((F.col("ord") % 25).cast("int")))
    rows = reads.lookup_reference(rows, _references(spark, sf_dir), "mate_rindex", "mate_rname")
    seq_text = F.when(F.col("ord") % 5 == 0, "").otherwise(F.substring(F.lit("ACGTNACGTN"), F.lit(1), (F.col("ord") % 10).cast("int")))
    return rows.withColumns(
        {"pos": F.col("zpos") + 1, "mate_pos": F.col("ord") % 1000, "isize": (F.col("ord") % 7 - 3).cast("bigint"), "seq": seq_text}
    ).withColumn("qual", F.when(F.col("ord") % 3 == 0, F.lit(None)).otherwise(F.repeat(F.lit("I"), F.length("seq"))))


_SEQ = "CASE WHEN ord%5=0 THEN '' ELSE substr('ACGTNACGTN', 1, CAST(ord%10 AS int)) END"
_MATE = "CASE WHEN ord%4=0 THEN rindex WHEN ord%4=1 THEN -1 ELSE CAST(ord%25 AS int) END"
_FULL = f"""(SELECT f.*, r.n_name AS rname, m.n_name AS mate_rname FROM (SELECT *, {_MATE} AS mate_rindex, {_SEQ} AS seq FROM aln) AS f
 LEFT JOIN nation AS r ON f.rindex = r.n_nationkey LEFT JOIN nation AS m ON f.mate_rindex = m.n_nationkey) AS f"""


@_query(
    f"""SELECT ord, concat_ws(chr(9), qname, {_bits(_TEXT)}, CASE WHEN rindex < 0 THEN '*' ELSE rname END, CAST(zpos + 1 AS string), CAST(mapq AS string), cigar,
 CASE WHEN mate_rindex < 0 THEN '*' WHEN mate_rindex = rindex THEN '=' ELSE mate_rname END, CAST(ord % 1000 AS string), CAST(ord % 7 - 3 AS string),
 CASE WHEN seq = '' THEN '*' ELSE seq END, CASE WHEN seq = '' OR ord%3=0 THEN '*' ELSE repeat('I', length(seq)) END, 'NM:i:' || CAST(mapq AS string),
 CASE WHEN rg IS NOT NULL THEN 'RG:Z:' || rg END, CASE WHEN ord%3=0 THEN 'XA:A:' || CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END END) AS line FROM {_FULL}"""
)
def sam_line(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return rows.select("ord", export.sam_line(rows, "text").alias("line"))


@_query(
    f"""SELECT ord, '@' || qname || CASE WHEN (flag & 64) <> 0 THEN '/1' WHEN (flag & 128) <> 0 THEN '/2' ELSE '' END || chr(10) || seq || chr(10) || '+' || chr(10)
 || CASE WHEN ord%3=0 THEN repeat('!', length(seq)) ELSE repeat('I', length(seq)) END AS entry FROM {_FULL}"""
)
def fastq(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return rows.select("ord", export.fastq(rows).alias("entry"))


@_query("SELECT ord, zpos + 101 AS pos, zpos + 100 AS zpos, least(mapq * 2, 255) AS mapq FROM aln WHERE rindex >= 0")
def record_change(spark, sf_dir):
    rows = _aln(spark, sf_dir).where("rindex >= 0").withColumn("pos", F.col("zpos") + 1)
    return reads.set_fields(rows, pos=F.col("pos") + 100, mapq=F.least(F.col("mapq") * 2, F.lit(255))).select("ord", "pos", "zpos", "mapq")


def _catalog(spark, sf_dir):
    """The header of a file of these reads."""
    from readloom.sources.header import HeaderCatalog

    names = [r["name"] for r in _references(spark, sf_dir).orderBy("rindex").collect()]
    groups = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return HeaderCatalog(["@HD\tVN:1.0", *(f"@SQ\tSN:{n}\tLN:{250_000_000 + i}" for i, n in enumerate(names)), *(f"@RG\tID:{g}\tLB:lib{i}" for i, g in enumerate(groups))])


def _file(spark, name: str) -> str:
    from readloom.session import scratch

    path = scratch(spark, name)
    return path if "://" in path or not path.startswith("file:") else "file://" + path[len("file:") :]


def _round_trip(spark, sf_dir, format: str, parts: bool = True) -> DataFrame:
    """The reads written to files and read back."""
    from readloom.sources import sam, write

    files = write.write_alignments(_full(spark, sf_dir), _catalog(spark, sf_dir), f"{_file(spark, format)}/{'' if parts else 'x.' + format}".rstrip("/"), format, parts=parts)
    back = sam.read_alignments(spark, *files) if format != "sam" else sam.read_alignments(spark, *files, split_bytes=1 << 20)
    return back.select(
        "qname", "flag", "rindex", "rname", "pos", "zpos", "mapq", "cigar", "mate_rindex", "mate_rname", "mate_pos", "isize", "seq", "qual", F.concat_ws(" ", aux.aux_text(F.col("aux"))).alias("fields")
    )


_FILE_ROWS = f"""SELECT qname, flag, rindex, CASE WHEN rindex < 0 THEN '*' ELSE rname END AS rname, zpos + 1 AS pos, zpos, mapq, cigar, mate_rindex,
 CASE WHEN mate_rindex < 0 THEN '*' ELSE mate_rname END AS mate_rname, CAST(ord % 1000 AS bigint) AS mate_pos, CAST(ord % 7 - 3 AS bigint) AS isize, seq,
 CASE WHEN seq = '' OR ord%3=0 THEN NULL ELSE repeat('I', length(seq)) END AS qual, concat_ws(' ', 'NM:i:' || CAST(mapq AS string),
 CASE WHEN rg IS NOT NULL THEN 'RG:Z:' || rg END, CASE WHEN ord%3=0 THEN 'XA:A:' || CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END END) AS fields FROM {_FULL}"""


@_query(_FILE_ROWS)
def sam_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "sam")


@_query(_FILE_ROWS)
def sam_gzip_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "sam.gz")


@_query(_FILE_ROWS)
def bam_round_trip(spark, sf_dir):
    return _round_trip(spark, sf_dir, "bam")


@_query(_FILE_ROWS)
def bam_single_file(spark, sf_dir):
    return _round_trip(spark, sf_dir, "ubam", parts=False)


def _bam_header(spark, sf_dir, catalog):
    """A header written to a BAM file and read back."""
    from readloom.sources import bam, files, sam

    path = _file(spark, "header")
    with files.open_file(path, write=True) as f:
        bam.BamWriter(f, catalog).close()
    return sam.read_header(path)


@_query("SELECT CAST(n_nationkey AS int) AS rindex, n_name AS name, CAST(250000000 + n_nationkey AS bigint) AS length FROM nation")
def header_references(spark, sf_dir):
    return _bam_header(spark, sf_dir, _catalog(spark, sf_dir)).references_frame(spark).select("rindex", "name", "length")


@_query("SELECT * FROM (VALUES ('1-URGENT', 'lib0'), ('2-HIGH', 'lib1'), ('3-MEDIUM', 'lib2'), ('4-NOT SPECIFIED', 'lib3'), ('5-LOW', 'lib4')) AS t(id, lb)")
def header_groups(spark, sf_dir):
    return _bam_header(spark, sf_dir, _catalog(spark, sf_dir)).groups_frame(spark).select("id", "lb")


@_query("SELECT CAST(n_nationkey + 1 AS int) AS line_no, 'SQ' AS type, '@SQ\tSN:' || n_name || '\tLN:' || CAST(250000000 + n_nationkey AS string) AS text FROM nation".replace("\t", "' || chr(9) || '"))
def header_lines(spark, sf_dir):
    return _catalog(spark, sf_dir).headers_frame(spark).where("type = 'SQ'").select("line_no", "type", "text")


@_query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey % 2, n_nationkey) - 1 AS int) AS rindex, n_name AS name, CAST(250000000 + n_nationkey AS bigint) AS length FROM nation")
def header_merge(spark, sf_dir):
    from readloom.sources.header import HeaderCatalog, merge_catalogs

    lines = [str(h) for h in _catalog(spark, sf_dir).of_type("SQ")]
    merged = merge_catalogs(HeaderCatalog(["@HD\tVN:1.0", *lines[::2]]), HeaderCatalog(["@HD\tVN:1.1", lines[0], *lines[1::2]]))
    return merged.references_frame(spark).select("rindex", "name", "length")


@_query("SELECT CAST(n_nationkey AS int) AS rindex, n_name AS name, CAST(CASE WHEN n_nationkey = 3 THEN 7 ELSE 250000000 + n_nationkey END AS bigint) AS length FROM nation UNION ALL SELECT 25, 'extra', 9")
def header_change(spark, sf_dir):
    catalog = _catalog(spark, sf_dir)
    catalog.push_back("@SQ\tSN:extra\tLN:9")
    catalog.insert(1, "@CO\ttext")
    catalog.replace(0, "@HD\tVN:1.4")
    catalog.set_reference(3, LN=7)
    return catalog.references_frame(spark).select("rindex", "name", "length")


@_query("SELECT rg AS readgroup, CAST(count(*) AS bigint) AS n, CAST(count(*) FILTER (WHERE (flag & 16) <> 0) AS bigint) AS n_reverse FROM aln WHERE rg IS NOT NULL AND (flag & 4) = 0 GROUP BY rg")
def split_files(spark, sf_dir):
    from functools import reduce

    from readloom.sources import sam, write

    rows = _full(spark, sf_dir).where("rg IS NOT NULL").withColumn("source", F.lit(0)).withColumn("ordinal", F.col("ord"))
    names = write.split_by_group(rows, _catalog(spark, sf_dir), "run.sam", _file(spark, "split"), "-u", template="%ID.%.", format="bam")
    back = reduce(lambda a, b: a.unionByName(b), [sam.read_alignments(spark, p).withColumn("readgroup", F.lit(g)) for g, p in names.items()])
    return back.groupBy("readgroup").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("flag").bitwiseAND(16)) != 0).alias("n_reverse"))


@_query("SELECT CAST(ord % 2 AS int) AS source, qname, zpos FROM aln")
def read_several_files(spark, sf_dir):
    from readloom.sources import sam, write

    rows, catalog, folder = _full(spark, sf_dir), _catalog(spark, sf_dir), _file(spark, "several")
    first = write.write_alignments(rows.where("ord % 2 = 0"), catalog, f"{folder}/a.sam", "sam")
    second = write.write_alignments(rows.where("ord % 2 = 1"), catalog, f"{folder}/b.bam", "bam")
    bad: list = []  # a file that is not there is noted, and the next is read
    return sam.read_alignments(spark, *first, *second, f"{folder}/none", bad_files=bad).select("source", "qname", "zpos")


def _stream(spark, sf_dir) -> DataFrame:
    """The reads as a stream of files."""
    path = _file(spark, "stream-in")
    rows = _aln(spark, sf_dir).select("ord", "qname", "flag", "mapq", "rg")
    rows.repartitionByRange(4, "ord").write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


def _drained(spark, stream: DataFrame) -> DataFrame:
    """All that a stream appends until its input ends."""
    path = _file(spark, "stream-out")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-log").option("path", path).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@_query("SELECT ord, qname FROM aln WHERE (flag & 4) = 0 AND mapq >= 10")
def stream_filter(spark, sf_dir):
    from readloom.streaming import flows

    return _drained(spark, flows.stream_filter(_stream(spark, sf_dir), "-u", min_quality=10).select("ord", "qname"))


@_query(
    """SELECT coalesce(rg, '(ungrouped)') AS readgroup, CAST(count(*) FILTER (WHERE (flag & 4) = 0) AS bigint) AS mapped,
 CAST(count(*) FILTER (WHERE (flag & 4) <> 0) AS bigint) AS unmapped FROM aln GROUP BY 1"""
)
def stream_counts(spark, sf_dir):
    from readloom.streaming import flows

    name = "counts_" + _file(spark, "x")[-32:]
    log = _file(spark, "stream-log")
    flows.stream_counts(_stream(spark, sf_dir)).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("readgroup", "mapped", "unmapped")  # a row for each read group


@_query("SELECT rg AS split_rg, CAST(count(*) AS bigint) AS n FROM aln WHERE rg IS NOT NULL GROUP BY rg")
def stream_split(spark, sf_dir):
    from readloom.streaming import flows

    path = _file(spark, "stream-split")
    flows.stream_split(_stream(spark, sf_dir).where("rg IS NOT NULL"), path, f"{path}-log").awaitTermination()
    return spark.read.parquet(path).groupBy("split_rg").agg(F.count(F.lit(1)).alias("n"))


@_query(
    f"""SELECT qname, min(ord) AS first_ord, max(ord) AS second_ord FROM ({_PAIRS}) AS p WHERE NOT single GROUP BY qname, pair_no"""
)
def stream_pairs(spark, sf_dir):
    from readloom.streaming import flows

    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, store)  # keeps state on disk; transformWithState needs it
    try:
        return _drained(spark, flows.stream_pairs(_stream(spark, sf_dir))).select("qname", "first_ord", "second_ord")
    finally:
        spark.conf.set(name, before)


@_query("SELECT ord, row_number() OVER (ORDER BY qname, ord) AS rank FROM aln")
def sort_name_rank(spark, sf_dir):
    return ordering.sort_rank(_aln(spark, sf_dir), "name", "ord").select("ord", "rank")


@_query(
    """SELECT ord, CAST(list_reduce(list_prepend(CAST(0 AS hugeint), list_transform(string_split(qname, ''), lambda c: CAST(ascii(c) AS hugeint))),
 lambda h, c: (h * 131 + c) % CAST('18446744073709551616' AS hugeint)) AS string) AS hash FROM aln"""
)
def qname_hash(spark, sf_dir):
    return _aln(spark, sf_dir).select("ord", reads.hash_by_qname(F.col("qname")).cast("string").alias("hash"))


@_query(
    """SELECT feat_id, zstart + 1 AS s, zlimit AS e, zlimit - 1 AS ze, zlimit + 1 AS l, zlimit - zstart AS n, CAST(4 AS bigint) AS moved_start, zlimit AS moved_limit, zstart + 10 AS cut_limit FROM feat"""
)
def interval_parts(spark, sf_dir):
    i = F.struct("zstart", "zlimit")
    moved, cut = intervals.set_interval(i, start=F.lit(5)), intervals.set_interval(i, length=F.lit(10))
    parts = {"s": intervals.start(i), "e": intervals.end(i), "ze": intervals.zend(i), "l": intervals.limit(i), "n": intervals.length(i)}
    parts |= {"moved_start": moved["zstart"], "moved_limit": moved["zlimit"], "cut_limit": cut["zlimit"]}
    return _feat(spark, sf_dir).select("feat_id", *[c.alias(k) for k, c in parts.items()])


@_query(
    """SELECT ord, cigar, CAST(len(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) AS int) AS n_ops, CASE WHEN cigar = '*' THEN '' ELSE regexp_extract(cigar, '^[0-9]+[MIDNSHP=X]') END AS first_op FROM aln"""
)
def cigar_parts(spark, sf_dir):
    ops = cigar.cigar_ops(F.col("cigar"))
    first = F.try_element_at(ops, F.lit(1))
    return _aln(spark, sf_dir).select("ord", cigar.cigar_text(ops).alias("cigar"), F.size(ops).alias("n_ops"), F.coalesce(F.concat(first["len"].cast("string"), first["op"]), F.lit("")).alias("first_op"))


@_query(
    """SELECT ord, concat_ws(' ', 'XB:Z:new', 'NM:i:7', CASE WHEN rg IS NOT NULL THEN 'RG:Z:' || rg END, CASE WHEN ord%3=0 THEN 'XA:A:' || CASE WHEN (flag & 16) <> 0 THEN '-' ELSE '+' END END) AS fields,
 CAST(CASE WHEN rg IS NOT NULL THEN length(rg) + 4 + 4 ELSE 4 END + CASE WHEN ord%3=0 THEN 4 ELSE 0 END AS bigint) AS n_bytes FROM aln"""
)
def aux_insert_replace(spark, sf_dir):
    a = F.col("aux")
    changed = aux.aux_replace(aux.aux_insert(a, 0, "XB", "Z", F.lit("new")), 1, "i", F.lit(7))
    total = F.aggregate(aux.aux_size(a), F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return _with_aux(spark, sf_dir).select("ord", F.concat_ws(" ", aux.aux_text(changed)).alias("fields"), total.alias("n_bytes"))


@_query("SELECT p_partkey, CASE p_partkey%4 WHEN 0 THEN 'bam' WHEN 1 THEN 'sam.gz' ELSE 'sam' END AS format FROM part")
def name_format(spark, sf_dir):
    from readloom.sources.write import format_column

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    kind = F.col("p_partkey") % 4
    ending = F.when(kind == 0, ".BAM").when(kind == 1, ".sam.gz").when(kind == 2, ".Sam").otherwise("")
    return part.select("p_partkey", format_column(F.concat(F.lit("x"), ending)).alias("format"))


@_query(
    f"""SELECT l.library, mapped, unmapped, CAST(coalesce(n, 0) AS bigint) AS feature_hits FROM ({_LIBRARIES}) AS l LEFT JOIN
 (SELECT lb, count(*) AS n FROM sp JOIN feat ON {_OVERLAP} JOIN rgh ON rg = id GROUP BY lb) AS h ON l.library = h.lb"""
)
def flagship(spark, sf_dir):
    rows, groups = _aln(spark, sf_dir), _rgh(spark, sf_dir)
    own = overlap.read_intervals(rows).select("ord", "rindex", "zstart", "zlimit", "rg")
    hits = overlap.overlap_join(own, _feat(spark, sf_dir), "rindex").join(groups, F.col("rg") == F.col("id"))
    per_library = hits.groupBy(F.col("lb").alias("h_lb")).agg(F.count(F.lit(1)).alias("n"))
    counts = reads.count_by_library(rows, groups).join(per_library, F.col("library") == F.col("h_lb"), "left")
    return counts.select("library", "mapped", "unmapped", F.coalesce("n", F.lit(0)).alias("feature_hits"))
