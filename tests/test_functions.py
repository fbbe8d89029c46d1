import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from readloom.functions import aux, cigar, flags, intervals, seq

H = 2147483647


def column(spark, values, kind, *expressions):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *[e.alias(f"c{k}") for k, e in enumerate(expressions)]).orderBy("i").collect()]


def test_all_flags_in_all_styles(spark):
    f = F.col("id").cast("int")
    texts = {s: flags.format_flags(f, s) for s in ("dec", "oct", "hex")} | {"text": F.concat(F.lit("_"), flags.flag_text(f))}
    rows = spark.range(4096).select("id", *[t.alias(s) for s, t in texts.items()], *[flags.parse_flags_column(t).alias(f"p_{s}") for s, t in texts.items()]).collect()
    for r in rows:
        assert r.dec == str(r.id) and r.oct == ("0" if r.id == 0 else f"0{r.id:o}") and r.hex == ("0" if r.id == 0 else f"0x{r.id:X}")
        assert r.p_dec == r.p_oct == r.p_hex == r.p_text == r.id
        assert flags.parse_flags(r.text) == flags.parse_flags(r.hex) == flags.parse_flags(r.oct) == r.id


@pytest.mark.parametrize("text,value", [("1", 1), ("010", 8), ("0x10", 16), ("0X1f", 31), ("", 0), ("u1", 68), ("pPfF_", 3), ("q", 512), ("S", 2048)])
def test_flag_texts(spark, text, value):
    assert flags.parse_flags(text) == value
    assert column(spark, [text], "string", flags.parse_flags_column(F.col("v"))) == [(value,)]


@pytest.mark.parametrize("text", ["1p", "z", "08", "0x", "+", "9x"])
def test_bad_flags(spark, text):
    with pytest.raises(flags.FormatError):
        flags.parse_flags(text)
    with pytest.raises(PySparkException):
        column(spark, [text], "string", flags.parse_flags_column(F.col("v")))


def test_flag_expressions():
    assert flags.parse_expression("+pP-u") == (3, 4)
    assert flags.parse_expression("f") == (0, 16)
    assert flags.parse_expression("-f") == (16, 0)
    assert flags.parse_expression("F") == (0, 32)
    assert flags.parse_expression("+3-16") == (3, 16)
    assert flags.parse_expression("p", "-u", "+0x0f") == (15, 4)
    assert flags.parse_expression("") == (0, 0)


def test_cigar_operators(spark):
    for code, (op, query, ref) in enumerate(zip("MIDNSHP=X", (1, 1, 0, 0, 1, 0, 0, 1, 1), (1, 0, 1, 1, 0, 0, 0, 1, 1))):
        assert (cigar.encode_op(op), cigar.decode_op(code)) == (code, op)
        ops = cigar.cigar_ops(F.col("v"))
        n = 100 + 53 * code
        got = column(spark, [f"{n}{op}"], "string", cigar.cigar_text(ops), cigar.query_length(ops), cigar.cigar_span(F.lit(0), ops), cigar.cigar_op(ops, 0)["len"])
        assert got == [(f"{n}{op}", n * query, max(1, n * ref), n)]
    for bad in ("x", 9, -1):
        with pytest.raises(ValueError):
            cigar.encode_op(bad) if isinstance(bad, str) else cigar.decode_op(bad)


def test_cigar_span_and_errors(spark):
    ops = cigar.cigar_ops(F.col("v"))
    assert column(spark, ["10M2I5D3S", "5S", "*", ""], "string", cigar.cigar_span(F.lit(0), ops), cigar.cigar_span(F.lit(4), ops)) == [(15, 1), (1, 1), (1, 1), (1, 1)]
    for bad in ("M", "10", "10Q", "M10", "5M*"):
        with pytest.raises(PySparkException):
            column(spark, [bad], "string", ops)


def test_bins(spark):
    cases = [(-1, -1, 4680), (0, 0, 4681), (16383, 16384, 585), (131071, 131072, 73), (0, 2**29 - 1, 0)]
    df = spark.createDataFrame(cases, "a bigint, b bigint, want int")
    assert all(r.got == r.want and r.one == r.want for r in df.select("want", cigar.zbin(F.col("a"), F.col("b")).alias("got"), cigar.bin_of(F.col("a") + 1, F.col("b") + 1).alias("one")).collect())


SEQS = {"": "", "A": "10", "C": "20", "G": "40", "T": "80", "AT": "18", "TG": "84", "GC": "42", "GATTACA": "41881210", "AACGTCCTGCAGGATTA": "112482284214418810", "acmgrsvtwyhkdb.": "123456789ABCDEF0"}


def test_sequences(spark):
    packed = seq.pack_seq(F.col("v"))
    got = column(spark, list(SEQS), "string", F.hex(packed), seq.unpack_seq(packed, F.length("v")))
    assert got == [(h, s.upper().replace(".", "N")) for s, h in SEQS.items()]
    with pytest.raises(PySparkException):
        column(spark, ["ATZ"], "string", packed)
    assert column(spark, ["ACGN"], "string", seq.reverse_complement(F.col("v"))) == [("NCGT",)]


def test_qualities(spark):
    v = seq.qual_values(F.col("v"))
    assert column(spark, ["I?!", "*", ""], "string", v, seq.qual_text(v)) == [([40, 30, 0], "I?!"), (None, None), ([], "")]
    with pytest.raises(PySparkException):
        column(spark, ["a b"], "string", v)


def test_aux_fields(spark):
    a = aux.aux_parse(F.split(F.col("v"), " "))
    rows = ["XS:Z:carrot XI:i:37 XC:A:q", "XI:i:300 XI:i:5"]
    got = column(
        spark, rows, "string", aux.aux_string(a, "XS", F.lit("none")), aux.aux_int(a, "XI"), aux.aux_string(a, "XI"), F.array_join(aux.aux_text(aux.aux_set(a, "XI", "i", F.lit(9))), " "),
        F.array_join(aux.aux_text(aux.aux_erase(a, "XI")), " "), aux.aux_erased_count(a, "XI"), aux.aux_size(a), F.size(aux.aux_clear(a)),
        F.array_join(aux.aux_text(aux.aux_insert(a, 1, "ZZ", "Z", F.lit("n"))), " "), F.array_join(aux.aux_text(aux.aux_replace(a, 0, "Z", F.lit("r"))), " "), F.array_join(aux.aux_text(aux.aux_erase_range(a, 0, 1)), " "),
    )
    assert got == [
        ("carrot", 37, "37", "XS:Z:carrot XI:i:9 XC:A:q", "XS:Z:carrot XC:A:q", 1, [10, 4, 4], 0, "XS:Z:carrot ZZ:Z:n XI:i:37 XC:A:q", "XS:Z:r XI:i:37 XC:A:q", "XI:i:37 XC:A:q"),
        ("none", 300, "300", "XI:i:9 XI:i:5", "", 2, [5, 4], 0, "XI:i:300 ZZ:Z:n XI:i:5", "XI:Z:r XI:i:5", "XI:i:5"),
    ]
    for bad in (aux.aux_string(a, "QQ"), aux.aux_int(a, "XS"), aux.aux_char(a, "XS")):
        with pytest.raises(PySparkException):
            column(spark, rows[:1], "string", bad)
    for text in ("NM:i:x", "X:i:1", "XA:A:ab", "XH:H:abc", "NMi1"):
        with pytest.raises(PySparkException):
            column(spark, [text], "string", a)
    kinds = column(spark, [127, 128, 255, 256, 32767, 32768, 65535, 65536, -1, -129, -32769, 1 << 31], "bigint", aux.integer_type(F.col("v")))
    assert "".join(k for (k,) in kinds) == "cCCssSSicsiI"


INTERVALS = {"300": (300, 300), "1,100-2,543": (1100, 2543), "-200": (1, 200), "4,123,456-": (4123456, H), "-": (1, H), "": (1, 1), "1,100+150": (1100, 1249), "1,100+": (1100, 1099), "+100": (1, 100)}
NAMED = {
    "ChrMT:1,100-2,543": ("ChrMT", 1100, 2543), "Chr whatever": ("Chr whatever", 1, H), "15:-600005": ("15", 1, 600005), "1:10000-": ("1", 10000, H), "8:12,500+1,101": ("8", 12500, 13600),
    "8:+2,000": ("8", 1, 2000), "8:2,000+": ("8", 2000, 1999), "18:98,765": ("18", 98765, 98765), ":50-80": ("", 50, 80), "foo": ("foo", 1, H), "foo:": ("foo", 1, 1), ":": ("", 1, 1), "": ("", 1, H), "a:b:5": ("a:b", 5, 5),
}


def test_interval_texts(spark):
    i, s = intervals.interval_column(F.col("v")), intervals.seqinterval_column(F.col("v"))
    assert column(spark, list(INTERVALS), "string", i["zstart"] + 1, i["zlimit"]) == list(INTERVALS.values())
    assert column(spark, list(NAMED), "string", s["name"], s["zstart"] + 1, s["zlimit"]) == list(NAMED.values())
    assert all((a + 1, b) == INTERVALS[t] for t in INTERVALS for a, b in [intervals.parse_interval(t)])
    assert all((n, a + 1, b) == NAMED[t] for t in NAMED for n, a, b in [intervals.parse_seqinterval(t)])
    assert column(spark, ["x"], "string", intervals.seqinterval_text(F.col("v"), F.lit(9), F.lit(20))) == [("x:10-20",)]
    for bad in ("1-2-3", "x", "1 2", ",", "1-,"):
        with pytest.raises(intervals.FormatError):
            intervals.parse_interval(bad)
        with pytest.raises(PySparkException):
            column(spark, [bad], "string", i)


@settings(max_examples=200, deadline=None)
@given(st.text("pPuUrR12sqxdSfF_+-0x19a", max_size=8))
def test_expressions_never_fail_oddly(text):
    try:
        masks = flags.parse_expression(text)
    except flags.FormatError:
        return
    assert all(m >= 0 for m in masks)
