"""CIGAR strings as arrays of (len, op), spans, and index bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.flags import Flag, is_set

#: Operators by code, and which of them use query or reference.
OPERATORS = "MIDNSHP=X"
QUERY = tuple("MIS=X")
REFERENCE = tuple("MDN=X")


def encode_op(op: str) -> int:
    if len(op) != 1 or op not in OPERATORS:
        raise ValueError(f"not a CIGAR operator: {op!r}")
    return OPERATORS.index(op)


def decode_op(code: int) -> str:
    if not 0 <= code < len(OPERATORS):
        raise ValueError(f"not a CIGAR operator code: {code}")
    return OPERATORS[code]


def cigar_ops(text: Column) -> Column:
    """array<struct<len bigint, op string>>; ``*`` is empty, malformed text raises."""
    each = F.regexp_extract_all(text, F.lit(f"([0-9]+)([{OPERATORS}])"), F.lit(0))
    ops = F.transform(each, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("bigint").alias("len"), F.right(x, F.lit(1)).alias("op")))
    none = F.array().cast("array<struct<len:bigint,op:string>>")
    wrong = F.raise_error(F.concat(F.lit("not a CIGAR string: "), text)).cast("array<struct<len:bigint,op:string>>")
    return F.when(text.isin("*", ""), none).when(text.rlike(f"^([0-9]+[{OPERATORS}])+$"), ops).otherwise(wrong)


def cigar_text(ops: Column) -> Column:
    joined = F.array_join(F.transform(ops, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.when(F.size(ops) == 0, "*").otherwise(joined)


def consumes_query(op: Column) -> Column:
    return op.isin(*QUERY)


def consumes_reference(op: Column) -> Column:
    return op.isin(*REFERENCE)


def cigar_op(ops: Column, index: int) -> Column:
    """The operator at an index from 0; raises where there is none."""
    return F.element_at(ops, index + 1)


def _total(ops: Column, keep) -> Column:
    return F.aggregate(F.filter(ops, lambda x: keep(x["op"])), F.lit(0).cast("bigint"), lambda acc, x: acc + x["len"])


def query_length(ops: Column) -> Column:
    return _total(ops, consumes_query)


def cigar_span(flag: Column, ops: Column) -> Column:
    """Reference bases covered: at least 1, and 1 for unmapped reads."""
    return F.when(is_set(flag, Flag.UNMAPPED), F.lit(1).cast("bigint")).otherwise(F.greatest(F.lit(1).cast("bigint"), _total(ops, consumes_reference)))


def right_pos(pos: Column, span: Column) -> Column:
    """The last position covered; for a zero-based start give a zero-based end."""
    return pos + span - 1


#: First bin of each level of the binning scheme, by shift.
LEVELS = ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))


def zbin(zpos: Column, zright: Column) -> Column:
    """The smallest bin that holds both zero-based positions."""
    out = F.lit(0).cast("bigint")
    for shift, first in reversed(LEVELS):
        out = F.when(F.shiftright(zpos, shift) == F.shiftright(zright, shift), F.shiftright(zpos, shift) + first).otherwise(out)
    return out.cast("int")


def bin_of(pos: Column, right: Column) -> Column:
    return zbin(pos - 1, right - 1)


def bins_overlapping(zstart: int, zlimit: int) -> list[tuple[int, int]]:
    """Ranges of bins that can hold anything that overlaps [zstart, zlimit)."""
    last = max(zstart, zlimit - 1)
    return [(0, 0), *((first + (zstart >> shift), first + (last >> shift)) for shift, first in LEVELS)]
