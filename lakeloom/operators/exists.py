"""Relationship existence and counts: semi joins, EXISTS subqueries and pre-aggregated counts."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Columns, DefinitionError, EntityMeta
from ..relations import Composed, Pivot, Relation, Through

if TYPE_CHECKING:
    from ..sources.session import Session

_numbers = itertools.count()
Condition = Callable[["Cond"], Column]


def fresh(prefix: str = "x") -> str:
    return f"{prefix}{next(_numbers)}"


class Cond(Columns):
    """What a condition gets: the columns of the table in question, and tests on its relationships."""

    def __init__(self, session: Session, meta: EntityMeta, alias: str, scoped: bool):
        super().__init__(meta, alias)
        self._session, self._scoped = session, scoped

    def where_has(self, rel: Any, cond: Condition | None = None) -> Column:
        return exists_column(self._session, rel, self._alias, cond, self._scoped)

    def doesnt_have(self, rel: Any, cond: Condition | None = None) -> Column:
        return ~exists_column(self._session, rel, self._alias, cond, self._scoped)

    def has(self, rel: Any, test: Callable[[Column], Column], cond: Condition | None = None) -> Column:
        found = related(self._session, rel, cond, self._scoped)
        return test(found.rows.where(found.link(F.col(f"`{self._alias}`.`{found.source_key}`").outer())).select(F.count("*")).scalar())


class Related:
    """The rows that a relationship leads to, filtered, with the column that names the parent."""

    def __init__(self, rows: DataFrame, source_key: str, key: Column):
        self.rows, self.source_key, self.key = rows, source_key, key

    def link(self, parent: Column) -> Column:
        return self.key == parent


def scoped_table(session: Session, meta: EntityMeta, alias: str, cond: Condition | None, scoped: bool) -> DataFrame:
    rows = session.table(meta).alias(alias)
    columns = Cond(session, meta, alias, scoped)
    if scoped:
        for scope in session.scopes_of(meta):
            for test in scope.conditions(columns):
                rows = rows.where(test)
    return rows.where(cond(columns)) if cond else rows


def related(session: Session, rel: Any, cond: Condition | None, scoped: bool) -> Related:
    """A pivot's target is read only if a condition or scope needs it: pivot rows count as they are."""
    a = fresh()
    if isinstance(rel, Relation):
        return Related(scoped_table(session, rel.target, a, cond, scoped), rel.source_key, F.col(f"`{a}`.`{rel.target_key}`"))
    b = fresh()
    if isinstance(rel, Pivot):
        pivot = session.frame(rel.table).select(rel.source_fk, rel.target_fk).alias(b)
        if cond or (scoped and session.scopes_of(rel.target)):
            target = scoped_table(session, rel.target, a, cond, scoped)
            pivot = pivot.join(target, F.col(f"`{b}`.`{rel.target_fk}`") == F.col(f"`{a}`.`{rel.target_key}`"))
        return Related(pivot, rel.source_key, F.col(f"`{b}`.`{rel.source_fk}`"))
    if isinstance(rel, Through):
        middle, target = scoped_table(session, rel.middle, b, None, scoped), scoped_table(session, rel.target, a, cond, scoped)
        rows = middle.join(target, F.col(f"`{b}`.`{rel.middle.key}`") == F.col(f"`{a}`.`{rel.target_fk}`"))
        return Related(rows, rel.source.key, F.col(f"`{b}`.`{rel.middle_fk}`"))
    if isinstance(rel, Composed):
        middle, target = scoped_table(session, rel.outer.target, b, None, scoped), scoped_table(session, rel.target, a, cond, scoped)
        rows = middle.join(target, F.col(f"`{b}`.`{rel.inner.source_key}`") == F.col(f"`{a}`.`{rel.inner.target_key}`"))
        return Related(rows, rel.outer.source_key, F.col(f"`{b}`.`{rel.outer.target_key}`"))
    raise DefinitionError(f"{rel!r} is no relationship")


def exists_column(session: Session, rel: Any, outer: str, cond: Condition | None, scoped: bool) -> Column:
    """EXISTS as a column: for use below OR and inside other conditions."""
    found = related(session, rel, cond, scoped)
    return found.rows.where(found.link(F.col(f"`{outer}`.`{found.source_key}`").outer())).exists()


def with_semi(rows: DataFrame, alias: str, session: Session, rel: Any, cond: Condition | None, scoped: bool, negated: bool) -> DataFrame:
    found = related(session, rel, cond, scoped)
    keys = found.rows.select(found.key.alias("_key")).alias(k := fresh("k"))
    return rows.join(keys, F.col(f"`{alias}`.`{found.source_key}`") == F.col(f"{k}._key"), "left_anti" if negated else "left_semi")


def with_counts(rows: DataFrame, alias: str, session: Session, rel: Any, cond: Condition | None, scoped: bool, name: str) -> tuple[DataFrame, Column]:
    """``rows`` joined to the counts of their related rows, and the count (0 where there are none).
    The children are counted before the join, so parents do not fan out."""
    found = related(session, rel, cond, scoped)
    counts = found.rows.groupBy(found.key.alias("_key")).agg(F.count("*").alias(name)).alias(k := fresh("k"))
    joined = rows.join(counts, F.col(f"`{alias}`.`{found.source_key}`") == F.col(f"{k}._key"), "left")
    return joined, F.coalesce(F.col(f"{k}.{name}"), F.lit(0).cast("long"))
