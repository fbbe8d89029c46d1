"""Auxiliary fields: array<struct<tag, type, value>> with values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AUX_TYPE = "array<struct<tag:string,type:string,value:string>>"

#: Size in bytes of fields by type, in the binary format.
SIZES = {"A": 4, "c": 4, "C": 4, "s": 5, "S": 5, "i": 7, "I": 7, "f": 7, "d": 11}
INTEGERS = tuple("cCsSiI")


def _parts(x: Column) -> tuple[Column, Column]:
    return F.substring(x, F.lit(6), F.length(x)), F.substring(x, 4, 1)


def aux_fits(x: Column) -> Column:
    """Whether a text is a well-formed field."""
    value, kind = _parts(x)
    fits = (
        F.when(kind == "i", value.rlike("^[-+]?[0-9]+$"))
        .when(kind == "A", F.length(value) == 1)
        .when(kind == "f", value.rlike(r"^[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?$|^[-+]?(inf|nan)$"))
        .when(kind == "H", value.rlike("^([0-9A-Fa-f]{2})*$"))
        .otherwise(kind.isin("Z", "B", "d"))
    )
    return (F.length(x) >= 5) & (F.substring(x, 3, 1) == ":") & (F.substring(x, 5, 1) == ":") & fits


def aux_parse(fields: Column) -> Column:
    """Fields from texts ``TG:T:VALUE``; malformed ones raise."""

    def one(x: Column) -> Column:
        value, kind = _parts(x)
        parsed = F.struct(F.substring(x, 1, 2).alias("tag"), kind.alias("type"), value.alias("value"))
        wrong = F.raise_error(F.concat(F.lit("not an auxiliary field: "), x)).cast("struct<tag:string,type:string,value:string>")
        return F.when(aux_fits(x), parsed).otherwise(wrong)

    return F.transform(fields, one)


def aux_text(aux: Column) -> Column:
    """Texts of the fields; all integer types are written as ``i``."""
    return F.transform(aux, lambda x: F.concat(x["tag"], F.lit(":"), F.when(x["type"].isin(*INTEGERS), "i").otherwise(x["type"]), F.lit(":"), x["value"]))


def aux_find(aux: Column, tag: str) -> Column:
    """The first field with a tag, or null."""
    return F.try_element_at(F.filter(aux, lambda x: x["tag"] == tag), F.lit(1))


def aux_has(aux: Column, tag: str) -> Column:
    return F.exists(aux, lambda x: x["tag"] == tag)


def _missing(tag: str) -> Column:
    return F.raise_error(F.lit(f"auxiliary field {tag!r} not found"))


def aux_string(aux: Column, tag: str, default: Column | None = None) -> Column:
    """The value as text; without a default a missing field raises."""
    found = aux_find(aux, tag)["value"]
    return F.coalesce(found, default if default is not None else _missing(tag).cast("string"))


def aux_int(aux: Column, tag: str, default: Column | None = None) -> Column:
    found = aux_find(aux, tag)
    number = F.when(found["type"].isin(*INTEGERS), found["value"].cast("bigint")).when(
        found.isNotNull(), F.raise_error(F.lit(f"auxiliary field {tag!r} is not an integer")).cast("bigint")
    )
    return F.coalesce(number, default if default is not None else _missing(tag).cast("bigint"))


def aux_char(aux: Column, tag: str, default: Column | None = None) -> Column:
    found = aux_find(aux, tag)
    char = F.when((found["type"] == "A") | ((found["type"] == "Z") & (F.length(found["value"]) == 1)), found["value"]).when(
        found.isNotNull(), F.raise_error(F.lit(f"auxiliary field {tag!r} is not a character")).cast("string")
    )
    return F.coalesce(char, default if default is not None else _missing(tag).cast("string"))


def aux_push(aux: Column, tag: str, kind: str, value: Column) -> Column:
    return F.concat(aux, F.array(_field(tag, kind, value)))


def aux_set(aux: Column, tag: str, kind: str, value: Column) -> Column:
    """Replaces the first field with the tag, or appends one."""
    at = F.array_position(F.transform(aux, lambda x: x["tag"]), tag)
    changed = F.transform(aux, lambda x, i: F.when(i + 1 == at, _field(tag, kind, value)).otherwise(x))
    return F.when(at > 0, changed).otherwise(aux_push(aux, tag, kind, value))


def aux_insert(aux: Column, index: int, tag: str, kind: str, value: Column) -> Column:
    field = F.array(_field(tag, kind, value))
    return F.concat(F.slice(aux, 1, index), field, F.slice(aux, index + 1, 1 << 20))


def aux_replace(aux: Column, index: int, kind: str, value: Column) -> Column:
    """A new value for the field at an index, which keeps its tag."""
    return F.transform(aux, lambda x, i: F.when(i == index, F.struct(x["tag"].alias("tag"), F.lit(kind).alias("type"), value.cast("string").alias("value"))).otherwise(x))


def aux_erase(aux: Column, tag: str) -> Column:
    return F.filter(aux, lambda x: x["tag"] != tag)


def aux_erased_count(aux: Column, tag: str) -> Column:
    return F.size(F.filter(aux, lambda x: x["tag"] == tag))


def aux_erase_range(aux: Column, start: int, stop: int) -> Column:
    return F.filter(aux, lambda x, i: (i < start) | (i >= stop))


def aux_clear(aux: Column) -> Column:
    return F.filter(aux, lambda x: F.lit(False))


def integer_type(value: Column) -> Column:
    """The smallest binary type of an integer, signed before unsigned."""
    return (
        F.when(value < -32768, "i").when(value < -128, "s").when(value <= 127, "c").when(value <= 255, "C")
        .when(value <= 32767, "s").when(value <= 65535, "S").when(value <= 2147483647, "i").otherwise("I")
    )


def aux_size(aux: Column) -> Column:
    """Bytes of each field in the binary format."""
    sizes = F.create_map(*[F.lit(x) for k, v in SIZES.items() for x in (k, v)])
    kind = lambda x: F.when(x["type"] == "i", integer_type(x["value"].cast("bigint"))).otherwise(x["type"])
    return F.transform(aux, lambda x: F.coalesce(F.try_element_at(sizes, F.when(x["type"].isin("Z", "H"), F.lit(None)).otherwise(kind(x))), F.octet_length(x["value"]) + 4))


def _field(tag: str, kind: str, value: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("type"), value.cast("string").alias("value"))
