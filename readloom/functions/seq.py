"""Packed sequences and base qualities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide codes 0 to 15, and the hexadecimal digits they pack to.
NUCLEOTIDES = "=ACMGRSVTWYHKDBN"
_DIGITS = "0123456789ABCDEF"
MAX_QUALITY = 93


def unpack_seq(packed: Column, length: Column) -> Column:
    return F.substring(F.translate(F.hex(packed), _DIGITS, NUCLEOTIDES), F.lit(1), length)


def pack_seq(seq: Column) -> Column:
    """Two bases a byte; a lone last base is padded with 0. Other letters raise."""
    upper = F.upper(F.translate(seq, ".", "N"))
    digits = F.translate(upper, NUCLEOTIDES, _DIGITS)
    even = F.concat(digits, F.when(F.length(seq) % 2 == 1, "0").otherwise(""))
    wrong = F.raise_error(F.concat(F.lit("not a sequence: "), seq)).cast("binary")
    return F.when(upper.rlike(f"^[{NUCLEOTIDES}]*$"), F.unhex(even)).otherwise(wrong)


def qual_values(qual: Column) -> Column:
    """Phred values of a quality string; null for ``*``; other characters raise."""
    wrong = F.raise_error(F.concat(F.lit("not qualities: "), qual)).cast("array<int>")
    values = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    return F.when(qual == "*", F.lit(None)).when(qual == "", F.array().cast("array<int>")).when(qual.rlike("^[!-~]+$"), values).otherwise(wrong)


def qual_text(values: Column) -> Column:
    """Text of Phred values, held between 0 and 93."""
    held = F.transform(values, lambda v: F.char(F.least(F.greatest(v, F.lit(0)), F.lit(MAX_QUALITY)) + 33))
    return F.array_join(held, "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACMGRSVTWYHKDBN", "TGKCYSBAWRDMHVN"))
