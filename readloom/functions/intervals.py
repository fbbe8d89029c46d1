"""Intervals on sequences: text forms, views and the overlap predicate.

Text is 1-based with the end included; zstart and zlimit are 0-based, half open.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from readloom.functions.flags import FormatError

#: Fixed value: the end of an interval without one.
UNBOUNDED = 2147483647
_FORM = r"^([0-9,]*)(?:([-+])([0-9,]*))?$"


def parse_interval(text: str) -> tuple[int, int]:
    """(zstart, zlimit) of ``S``, ``S-E`` or ``S+LENGTH``."""
    m = re.match(_FORM, text)
    if not m or "" in (x.replace(",", "") for x in (m[1], m[3]) if x):
        raise FormatError(f"not an interval: {text!r}")
    number = lambda x, other: int(x.replace(",", "")) if x else other
    zstart = number(m[1], 1) - 1
    if m[2] == "-":
        return zstart, number(m[3], UNBOUNDED)
    return zstart, zstart + (number(m[3], 0) if m[2] else 1)


def parse_seqinterval(text: str) -> tuple[str, int, int]:
    """(name, zstart, zlimit); the last colon ends the name, none means all of it."""
    name, colon, rest = text.rpartition(":")
    return (name, *parse_interval(rest)) if colon else (text, *parse_interval("-"))


def interval_column(text: Column) -> Column:
    """struct<zstart bigint, zlimit bigint>; malformed text raises."""
    part = lambda i: F.translate(F.regexp_extract(text, _FORM, i), ",", "")
    number = lambda x, other: F.when(x == "", other).otherwise(x).cast("bigint")
    sign = F.regexp_extract(text, _FORM, 2)
    zstart = number(part(1), "1") - 1
    zlimit = F.when(sign == "-", number(part(3), str(UNBOUNDED))).when(sign == "+", zstart + number(part(3), "0")).otherwise(zstart + 1)
    wrong = F.raise_error(F.concat(F.lit("not an interval: "), text)).cast("struct<zstart:bigint,zlimit:bigint>")
    good = text.rlike(_FORM) & ~text.rlike(r"^,+([-+]|$)|[-+],+$")
    return F.when(good, F.struct(zstart.alias("zstart"), zlimit.alias("zlimit"))).otherwise(wrong)


def seqinterval_column(text: Column) -> Column:
    """struct<name, zstart, zlimit>."""
    colon = F.instr(F.reverse(text), ":")
    name = F.when(colon == 0, text).otherwise(F.substring(text, F.lit(1), F.length(text) - colon))
    own = interval_column(F.when(colon == 0, "-").otherwise(F.right(text, colon - 1)))
    return F.struct(name.alias("name"), own["zstart"].alias("zstart"), own["zlimit"].alias("zlimit"))


def interval_text(zstart: Column, zlimit: Column) -> Column:
    return F.concat((zstart + 1).cast("string"), F.lit("-"), zlimit.cast("string"))


def seqinterval_text(name: Column, zstart: Column, zlimit: Column) -> Column:
    return F.concat(name, F.lit(":"), interval_text(zstart, zlimit))


def start(i: Column) -> Column:
    """The first position, from 1; zstart, zend and limit are the same places from 0 and behind the end."""
    return i["zstart"] + 1


def end(i: Column) -> Column:
    return i["zlimit"]


def zend(i: Column) -> Column:
    return i["zlimit"] - 1


def limit(i: Column) -> Column:
    return i["zlimit"] + 1


def length(i: Column) -> Column:
    return i["zlimit"] - i["zstart"]


def set_interval(i: Column, **values: Column) -> Column:
    """New start, zstart, end, zend, limit, zlimit or length; a length moves the end."""
    shift = {"start": ("zstart", -1), "zstart": ("zstart", 0), "end": ("zlimit", 0), "zend": ("zlimit", 1), "limit": ("zlimit", -1), "zlimit": ("zlimit", 0)}
    for name, value in values.items():
        field, by = shift.get(name, ("zlimit", 0))
        i = i.withField(field, (i["zstart"] + value if name == "length" else value + by).cast("bigint"))
    return i


def overlaps(a_start: Column, a_limit: Column, b_start: Column, b_limit: Column) -> Column:
    return (a_start < b_limit) & (b_start < a_limit)
