"""Expressions for projections: aggregates, raw SQL and order keys."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rawsql import bound


def count(column: Column | None = None) -> Column:
    return F.count("*") if column is None else F.count(column)


def count_distinct(column: Column) -> Column:
    return F.count_distinct(column)


def total(column: Column) -> Column:
    """Sum; Spark widens the type, so it does not overflow as the input type would."""
    return F.sum(column)


def average(column: Column) -> Column:
    return F.avg(column).cast("double")


def least(column: Column) -> Column:
    return F.min(column)


def greatest(column: Column) -> Column:
    return F.max(column)


def raw(sql: str, **values: Any) -> Column:
    """A SQL expression; ``:name`` stands for a bound value."""
    return F.expr(bound(sql, values))


def ordered(column: Column, descending: bool = False, nulls: str | None = None) -> Column:
    """An order key. Without ``nulls`` they come first ascending and last descending."""
    first = not descending if nulls is None else nulls == "first"
    if descending:
        return column.desc_nulls_first() if first else column.desc_nulls_last()
    return column.asc_nulls_first() if first else column.asc_nulls_last()
