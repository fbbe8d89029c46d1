"""Sort orders by name, sorting, checking and merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.flags import order
from readloom.operators.ranking import inversions, ranked

_ORDERS: dict[str, tuple[str, Callable[[], list[Column]]]] = {}


def register_order(name: str, description: str, keys: Callable[[], list[Column]]) -> None:
    """A new order, usable by its name."""
    _ORDERS[name] = (description, keys)


def orders() -> dict[str, str]:
    return {name: text for name, (text, _) in sorted(_ORDERS.items())}


def sort_keys(name: str) -> list[Column]:
    if name not in _ORDERS:
        raise ValueError(f"no such order: {name!r}; there are {', '.join(orders())}")
    return _ORDERS[name][1]()


def unsigned_index() -> Column:
    """Reference indexes with -1 (none) behind all others."""
    return F.when(F.col("rindex") < 0, F.lit(4294967295)).otherwise(F.col("rindex").cast("bigint"))


def _position() -> Column:
    return F.col("zpos")


register_order("location", "reference index (none last), position, name, first or second", lambda: [unsigned_index(), _position(), F.col("qname"), order(F.col("flag"))])
register_order("name", "name alone", lambda: [F.col("qname")])
register_order("qname", "name, first or second", lambda: [F.col("qname"), order(F.col("flag"))])


def sort_reads(df: DataFrame, by: str = "location", *ties: str) -> DataFrame:
    """All rows in order; Spark sorts by ranges and spills what does not fit."""
    return df.orderBy(*sort_keys(by), *ties)


def sort_rank(df: DataFrame, by: str = "location", *ties: str, name: str = "rank") -> DataFrame:
    """Adds each row's place in an order; ``ties`` decide between equal keys."""
    return ranked(df, [*sort_keys(by), *map(F.col, ties)], None, name)


def check_sorted(df: DataFrame, by: str = "location", ordinal: str = "ord") -> DataFrame:
    """One row: rows, and how many break the order; sorted if none does."""
    return inversions(df, [F.col(ordinal)], F.struct(*[k.alias(f"k{i}") for i, k in enumerate(sort_keys(by))]))


def merge_sorted(*frames: DataFrame, by: str = "location", ties: tuple[str, ...] = ()) -> DataFrame:
    """All rows of all inputs in one order, with their place; ``source`` breaks ties."""
    both = reduce(lambda a, b: a.unionByName(b), [f.withColumn("source", F.lit(i)) for i, f in enumerate(frames)])
    return sort_rank(both, by, "source", *ties)
