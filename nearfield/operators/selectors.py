"""Id predicates. Each is a Column for where=, so it holds before the search; large id sets are semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_range(low: int, high: int, column: str = "id") -> Column:
    """low <= id < high."""
    return (F.col(column) >= low) & (F.col(column) < high)


def id_in(ids: list[int], column: str = "id") -> Column:
    return F.col(column).isin(ids)


def id_bitmap(bitmap: bytes, column: str = "id") -> Column:
    """Bit id % 8 of byte id // 8; ids beyond the bitmap don't pass. The bitmap is one literal of the plan."""
    at = F.col(column).cast("long")
    byte = F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (at >= 0) & (at < 8 * len(bitmap)) & F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def translated(predicate: Column, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (id, ...) whose other name in ids (id, other) passes a predicate over `other`."""
    return rows.join(ids.where(predicate).select("id").distinct(), "id", "left_semi")


def negated(p: Column) -> Column:
    return ~p


def every(*p: Column) -> Column:
    return reduce(lambda a, b: a & b, p, F.lit(True))


def some(*p: Column) -> Column:
    return reduce(lambda a, b: a | b, p, F.lit(False))


def either(a: Column, b: Column) -> Column:
    """Exclusive or."""
    return a != b


def members(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids of any size."""
    return rows.join(ids.select(column).distinct(), column, "left_semi")


def others(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(column).distinct(), column, "left_anti")
