"""What a stored schema says of its rows: generated columns, NOT NULL, checks, keys.

Conditions on a single row are part of the write itself and fail it; unique columns and foreign keys
need a look at other rows, which costs a job, so it happens only where they are declared.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import EngineError

if TYPE_CHECKING:
    from .store import Store

_MARK = "constraint violated: "


class ConstraintViolated(EngineError):
    """A row does not meet what the table's schema says."""


def _notes(schema: T.StructType) -> Iterator[tuple[str, dict]]:
    for f in schema:
        yield f.name, dict(f.metadata or {})


def tests(schema: T.StructType, enums: dict[str, list[str]]) -> list[tuple[str, Column]]:
    """(name, condition that holds for each row)."""
    found = [(f"{f.name} must not be null", F.col(f"`{f.name}`").isNotNull()) for f in schema if not f.nullable]
    for name, notes in _notes(schema):
        if notes.get("check"):
            found.append((f"check on {name}: {notes['check']}", F.expr(notes["check"])))
        if notes.get("enum"):
            found.append((f"{name} takes the values of {notes['enum']} only", F.col(f"`{name}`").isin(enums.get(notes["enum"], []))))
        for key, what in dict(notes.get("constraints", {})).items():
            if what[0] == "check":
                found.append((f"check {key}: {what[1]}", F.expr(what[1])))
    return found


def checked(rows: DataFrame, schema: T.StructType, enums: dict[str, list[str]]) -> DataFrame:
    """The columns of ``schema``, generated ones computed; the write fails where a test does not hold."""
    made = {name: F.expr(notes["generated"]) for name, notes in _notes(schema) if notes.get("generated")}
    rows = rows.select(*[(made[f.name].cast(f.dataType).alias(f.name) if f.name in made else F.col(f"`{f.name}`")) for f in schema])
    for says, test in tests(schema, enums):
        # unknown passes, as in SQL
        rows = rows.where(F.when(F.coalesce(test, F.lit(True)), F.lit(True)).otherwise(F.raise_error(F.lit(_MARK + says)).cast("boolean")))
    return rows


@contextmanager
def told() -> Iterator[None]:
    """Turns the failure of a write into the constraint that it broke."""
    try:
        yield
    except PySparkException as failure:
        text = str(failure)
        if _MARK not in text:
            raise
        raise ConstraintViolated(text.split(_MARK, 1)[1].splitlines()[0].split(" SQLSTATE")[0]) from None
    except Exception as failure:  # a failed task arrives as an error of the JVM
        text = str(failure)
        if _MARK not in text:
            raise
        raise ConstraintViolated(text.split(_MARK, 1)[1].splitlines()[0].split(" SQLSTATE")[0]) from None


def unique_sets(schema: T.StructType) -> list[list[str]]:
    key = [name for name, notes in _notes(schema) if notes.get("primary_key")]
    found = [key] if key else []
    for name, notes in _notes(schema):
        if notes.get("unique"):
            found.append([name])
        found += [list(what[1:]) for what in dict(notes.get("constraints", {})).values() if what[0] == "unique"]
    return found


def foreign_keys(schema: T.StructType) -> list[tuple[str, str, str]]:
    """(column, table, column there)."""
    found = []
    for name, notes in _notes(schema):
        if notes.get("references"):
            found.append((name, notes["references"][0], notes["references"][1]))
        found += [(name, what[1], what[2]) for what in dict(notes.get("constraints", {})).values() if what[0] == "foreign key"]
    return found


def among_rows(store: Store, table: str, schema: T.StructType, new: DataFrame, old: DataFrame | None) -> None:
    """Unique columns over ``new`` (and against ``old``), and the foreign keys of ``new``."""
    for names in unique_sets(schema):
        keys = new.dropna(subset=names).select(*names)
        twice = not keys.groupBy(*names).count().where("count > 1").isEmpty()
        if twice or old is not None and not old.select(*names).join(keys, names, "left_semi").isEmpty():
            raise ConstraintViolated(f"{', '.join(names)} of {table} must be unique")
    for name, other, key in foreign_keys(schema):
        if other == table:
            there = new if old is None else new.unionByName(old)
        else:
            there = store.read(other)
        known = there.select(F.col(f"`{key}`").alias("_key")).distinct()
        if not new.where(F.col(f"`{name}`").isNotNull()).join(known, F.col(f"`{name}`") == F.col("_key"), "left_anti").isEmpty():
            raise ConstraintViolated(f"{name} of {table} must be a {key} of {other}")
