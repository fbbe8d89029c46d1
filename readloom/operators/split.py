"""Splitting by read group: names of outputs, counts and routing."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.reads import filter_reads, lookup_group

DEFAULT_TEMPLATE = "%*-%ID.%."


def base_name(path: str) -> str:
    """A file's name up to its first dot; standard input is ``stdin``."""
    return "stdin" if path == "-" else os.path.basename(path).split(".", 1)[0]


def expand_template(template: str, fields: dict[str, str], number: int, path: str, extension: str) -> str:
    """%XY header field, %# number from 1, %* input name, %. extension, %% percent."""

    def one(m: re.Match) -> str:
        key = m[1]
        if key == "%":
            return "%"
        if key == "#":
            return str(number)
        if key == "*":
            return base_name(path)
        if key == ".":
            return extension
        if not re.fullmatch(r"[A-Za-z][A-Za-z0-9]", key):
            raise ValueError(f"bad template: {template!r}")
        if key not in fields:
            raise ValueError(f"read group has no field {key!r}")
        return fields[key]

    return re.sub(r"%([%#*.]|.{0,2})", one, template, flags=re.S)


def expand_column(template: str, fields: dict[str, Column], number: Column, path: str, extension: str) -> Column:
    """As expand_template() with columns for fields; a null field raises."""
    parts: list[Column] = []
    for literal, key in re.findall(r"([^%]+)|%([%#*.]|.{0,2})", template, flags=re.S):
        if literal:
            parts.append(F.lit(literal))
        elif key in "%#*." and key:
            parts.append({"%": F.lit("%"), "#": number.cast("string"), "*": F.lit(base_name(path)), ".": F.lit(extension)}[key])
        elif key in fields:
            parts.append(F.coalesce(fields[key], F.raise_error(F.lit(f"read group has no field {key!r}")).cast("string")))
        else:
            raise ValueError(f"bad template: {template!r}")
    return F.concat(*parts) if parts else F.lit("")


def split_counts(df: DataFrame, groups: DataFrame, *flags: str, min_quality: int = 0, read_group: str = "rg") -> DataFrame:
    """Reads that go to each group's output; groups without reads count 0."""
    counts = filter_reads(df, *flags, min_quality=min_quality).groupBy(F.col(read_group).alias("c_id")).agg(F.count(F.lit(1)).alias("c_n"))
    own = groups.select("id").dropDuplicates(["id"])
    return own.join(counts, F.col("id") == F.col("c_id"), "left").select("id", F.coalesce("c_n", F.lit(0)).alias("n_reads"))


def route(df: DataFrame, groups: DataFrame, *flags: str, min_quality: int = 0, read_group: str = "rg") -> DataFrame:
    """Selected reads with their group; a read without a known group raises."""
    return lookup_group(filter_reads(df, *flags, min_quality=min_quality), groups, read_group, last=False)
