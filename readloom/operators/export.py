"""Records as text: SAM lines and FASTQ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.aux import aux_text
from readloom.functions.flags import Flag, format_flags, is_set
from readloom.functions.seq import reverse_complement


def sam_line(df: DataFrame, flag_style: str = "dec") -> Column:
    """The SAM text line of each row; ``aux`` is used if the rows have it."""
    mate = (
        F.when(F.col("mate_rindex") < 0, "*").when(F.col("mate_rindex") == F.col("rindex"), "=").otherwise(F.col("mate_rname"))
    )
    no_seq = F.length("seq") == 0
    fields = [
        F.col("qname"), format_flags(F.col("flag"), flag_style), F.when(F.col("rindex") < 0, "*").otherwise(F.col("rname")),
        F.col("pos").cast("string"), F.col("mapq").cast("string"), F.when(F.col("cigar") == "", "*").otherwise(F.col("cigar")), mate,
        F.col("mate_pos").cast("string"), F.col("isize").cast("string"),
        F.when(no_seq, "*").otherwise(F.col("seq")), F.when(no_seq, "*").otherwise(F.coalesce("qual", F.lit("*"))),
    ]
    if "aux" in df.columns:
        return F.concat_ws("\t", *fields, aux_text(F.col("aux")))
    return F.concat_ws("\t", *fields)


def fastq(df: DataFrame, revcomp: bool = False) -> Column:
    """Four lines for each read; missing qualities are ``!``; ``/1`` wins over ``/2``.

    Sequences stay as they are aligned unless ``revcomp`` turns reverse reads.
    """
    flag = F.col("flag")
    end = F.when(is_set(flag, Flag.FIRST_IN_PAIR), "/1").when(is_set(flag, Flag.SECOND_IN_PAIR), "/2").otherwise("")
    seq, qual = F.col("seq"), F.coalesce(F.col("qual"), F.repeat(F.lit("!"), F.length("seq")))
    if revcomp:
        turned = is_set(flag, Flag.REVERSE_STRAND)
        seq, qual = F.when(turned, reverse_complement(seq)).otherwise(seq), F.when(turned, F.reverse(qual)).otherwise(qual)
    return F.concat(F.lit("@"), F.col("qname"), end, F.lit("\n"), seq, F.lit("\n+\n"), qual)
