"""Filters, lookups, counts and record changes on alignment rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions import aux as aux_functions
from readloom.functions.flags import Flag, has_flags, is_set, parse_expression

UNGROUPED = "(ungrouped)"


def filter_reads(df: DataFrame, *flags: str, min_quality: int = 0) -> DataFrame:
    """Rows that meet flag expressions such as ``+pP-u`` and a mapping quality."""
    required, excluded = parse_expression(*flags)
    keep = has_flags(F.col("flag"), required, excluded)
    return df.where(keep & (F.col("mapq") >= min_quality) if min_quality > 0 else keep)


def filter_statistics(df: DataFrame, *flags: str, min_quality: int = 0) -> DataFrame:
    """One row: records read and records that the filter keeps."""
    required, excluded = parse_expression(*flags)
    keep = has_flags(F.col("flag"), required, excluded) & (F.col("mapq") >= min_quality)
    return df.agg(F.count(F.lit(1)).alias("n_in"), F.count_if(keep).alias("n_out"))


def concat(*frames: DataFrame) -> DataFrame:
    """All rows of all inputs; ``source`` numbers the inputs in order from 0."""
    numbered = [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def lookup_reference(df: DataFrame, references: DataFrame, index: str = "rindex", name: str = "rname", key: str = "rindex", value: str = "name") -> DataFrame:
    """Adds a reference's name; no reference is ``*``; an unknown index raises.

    References are a header's and fit a broadcast where the planner finds them
    small; beyond its threshold the planner joins by shuffle.
    """
    own = references.select(F.col(key).alias("ref_key"), F.col(value).alias("ref_value"))
    wrong = F.raise_error(F.concat(F.lit("no such reference: "), F.col(index).cast("string"))).cast("string")
    found = F.when(F.col(index) < 0, "*").otherwise(F.coalesce("ref_value", wrong))
    return df.join(own, F.col(index) == F.col("ref_key"), "left").withColumn(name, found).drop("ref_key", "ref_value")


def lookup_index(df: DataFrame, references: DataFrame, name: str = "rname", index: str = "rindex", allow_undeclared: bool = False) -> DataFrame:
    """Adds a reference's index by name; ``*`` is -1; an unknown name raises."""
    own = references.select(F.col("name").alias("ref_name"), F.col("rindex").alias("ref_index"))
    wrong = F.lit(-1) if allow_undeclared else F.raise_error(F.concat(F.lit("no such reference: "), F.col(name))).cast("int")
    found = F.when(F.col(name) == "*", -1).otherwise(F.coalesce("ref_index", wrong))
    return df.join(own, F.col(name) == F.col("ref_name"), "left").withColumn(index, found).drop("ref_name", "ref_index")


def one_of_each_id(groups: DataFrame, last: bool = True) -> DataFrame:
    """One row for each group id: of lines that repeat one, the last or the first by ``line_no``.

    Without that column all rows of an id must be equal; rows that differ raise.
    """
    rest = F.struct(*[c for c in groups.columns if c not in ("id", "line_no")])
    if "line_no" in groups.columns:
        pick = (F.max_by if last else F.min_by)(rest, "line_no")
    else:
        pick = F.when(F.count_distinct(F.to_json(rest)) > 1, F.raise_error(F.concat(F.lit("read group occurs twice: "), F.first("id"))).cast("string")).otherwise(F.lit(None))
        pick = F.when(pick.isNull(), F.first(rest))
    return groups.groupBy("id").agg(pick.alias("rest")).select("id", "rest.*") if len(groups.columns) > 1 else groups.distinct()


def lookup_group(df: DataFrame, groups: DataFrame, read_group: str = "rg", last: bool = True) -> DataFrame:
    """Adds the header columns of each read's group; a read without one raises.

    Of header lines that repeat an id the last counts, or the first.
    """
    own = one_of_each_id(groups, last)
    own = own.select([F.col(c).alias(f"rg_{c}") for c in own.columns])
    missing = F.when(F.col(read_group).isNull(), F.raise_error(F.lit("auxiliary field 'RG' not found")).cast("string"))
    unknown = F.raise_error(F.concat(F.lit("no header for read group "), F.col(read_group))).cast("string")
    joined = df.join(own, F.col(read_group) == F.col("rg_id"), "left")
    return joined.withColumn("rg_id", F.coalesce(missing, "rg_id", unknown))


def hash_by_qname(name: Column) -> Column:
    """The names' polynomial hash of base 131 modulo 2^64, as decimal(38,0); ASCII names."""
    wide = "decimal(38,0)"
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c).cast(wide))
    step = lambda h, c: ((h * F.lit(131).cast("decimal(3,0)") + c) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.aggregate(codes, F.lit(0).cast("decimal(20,0)"), step).cast(wide)


def read_group(df: DataFrame) -> Column:
    """A read's group: the auxiliary field RG, or null."""
    return aux_functions.aux_find(df["aux"], "RG")["value"]


def _mapped() -> tuple[Column, Column]:
    unmapped = is_set(F.col("flag"), Flag.UNMAPPED)
    return F.count_if(~unmapped).alias("mapped"), F.count_if(unmapped).alias("unmapped")


def count_by_group(df: DataFrame, read_group: str = "rg", by: tuple[str, ...] = ()) -> DataFrame:
    """Mapped and unmapped reads of each group (of each source, with ``by``)."""
    label = F.coalesce(F.col(read_group), F.lit(UNGROUPED)).alias("readgroup")
    return df.groupBy(*by, label).agg(*_mapped())


def count_by_library(df: DataFrame, groups: DataFrame, read_group: str = "rg") -> DataFrame:
    """Mapped and unmapped reads of each library of the header.

    Groups without a library have the library ""; groups without reads count
    zero; reads of groups that the header lacks are left out.
    """
    counts = count_by_group(df.where(F.col(read_group).isNotNull()), read_group)
    own = one_of_each_id(groups.select("id", F.coalesce("lb", F.lit("")).alias("library"), *[c for c in groups.columns if c == "line_no"])).withColumnRenamed("id", "g_id")
    joined = own.join(counts, F.col("g_id") == F.col("readgroup"), "left")
    return joined.groupBy("library").agg(F.coalesce(F.sum("mapped"), F.lit(0)).alias("mapped"), F.coalesce(F.sum("unmapped"), F.lit(0)).alias("unmapped"))


def set_fields(df: DataFrame, **values: Column) -> DataFrame:
    """New values for fields; positions keep their zero-based twin in step."""
    twins = {"pos": ("zpos", -1), "zpos": ("pos", 1), "mate_pos": ("mate_zpos", -1), "mate_zpos": ("mate_pos", 1)}
    for name, value in list(values.items()):
        twin = twins.get(name)
        if twin and twin[0] in df.columns:
            values[twin[0]] = value + twin[1]
    if "mapq" in values:
        bad = F.raise_error(F.lit("mapping quality out of range")).cast("int")
        values["mapq"] = F.when(values["mapq"].between(0, 255), values["mapq"]).otherwise(bad)
    return df.withColumns(values)
