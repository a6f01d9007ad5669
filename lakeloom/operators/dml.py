"""Row changes as functions from a table's rows to its new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    """True where the condition is true; unknown counts as false, so such rows stay as they are."""
    return F.coalesce(condition, F.lit(False))


def updated(rows: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    hit = holds(condition)
    kinds = {f.name: f.dataType for f in rows.schema}
    return rows.select(*[F.when(hit, values[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])


def deleted(rows: DataFrame, condition: Column) -> DataFrame:
    return rows.where(~holds(condition))


def conformed(rows: DataFrame, to: DataFrame) -> DataFrame:
    """The columns of ``to`` in order and type; what is missing is null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in to.schema])


def replaced(rows: DataFrame, new: DataFrame, on: Sequence[str], assign: Mapping[str, Column] | None = None) -> DataFrame:
    """``rows`` as they are after an upsert, without those that it adds. Without ``assign`` rows with
    equal keys go (``added`` has their successors); with it they take ``old.x`` and ``new.x``."""
    if assign is None:
        return rows.join(new.select(*on).distinct(), list(on), "left_anti").select(*rows.columns)
    a, b = rows.alias("old"), new.alias("new")
    hit = F.col(f"new.{on[0]}").isNotNull()
    kinds = {f.name: f.dataType for f in rows.schema}
    return a.join(b, _equal(on, "old", "new"), "left").select(
        *[F.when(hit, assign[c].cast(kinds[c])).otherwise(F.col(f"old.{c}")).alias(c) if c in assign else F.col(f"old.{c}") for c in rows.columns]
    )


def added(rows: DataFrame, new: DataFrame, on: Sequence[str], assign: Mapping[str, Column] | None = None) -> DataFrame:
    """The rows that an upsert adds."""
    return conformed(new if assign is None else _absent(rows, new, on), rows)


def _absent(rows: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    return new.dropDuplicates(list(on)).join(rows.select(*on).distinct(), list(on), "left_anti").select(*new.columns)


def _equal(on: Sequence[str], a: str, b: str) -> Column:
    found = F.lit(True)
    for c in on:
        found = found & (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return found


def numbered(rows: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """``new`` with keys that go on from the greatest in ``rows``. New rows come from one statement's
    records, so numbering them in one partition is bounded by what the caller sent."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    rank = F.row_number().over(Window.orderBy(*order))
    return new.withColumn("_rank", rank).join(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_rank")).drop("_top", "_rank")


def sync_difference(have: DataFrame, want: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys of both sides with what a synchronisation does to them."""
    a = have.select(*on).distinct().withColumn("_have", F.lit(True))
    b = want.select(*on).distinct().withColumn("_want", F.lit(True))
    state = F.when(F.col("_have").isNull(), "attached").when(F.col("_want").isNull(), "detached").otherwise("unchanged")
    return a.join(b, list(on), "full").select(*on, state.alias("state"))
