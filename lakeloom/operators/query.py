"""The query builder: immutable descriptions that lower to one DataFrame."""

from __future__ import annotations

import copy
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import ordered
from ..model import CapabilityError, DefinitionError, NotFound
from ..rawsql import bound
from ..relations import Relation, meta_of
from ..sources.session import Session
from ..streaming.records import chunks, records
from . import dml
from .eager import ROW, EagerQuery, numbered_rows, target_rows
from .exists import Cond, Condition, exists_column, related, with_counts, with_semi
from .joins import JoinedQuery
from .paging import KeysetPaginator, OffsetPage
from .projection import ProjectedQuery

ROOT = "t0"
_ORDER = re.compile(r"(.*?)(?:\s+(asc|desc))?(?:\s+nulls\s+(first|last))?", re.I | re.S)


class Query:
    """Rows of one entity. Every clause returns a new query.

    Scope conditions are kept apart from the query's own and always hold; ``scopes_escape=True``
    gives OR its plain precedence over them.
    """

    def __init__(self, session: Session, entity: Any, scopes: tuple = (), scoped: bool = False, scopes_escape: bool = False):
        self.session, self.meta, self.scopes, self.scoped, self.scopes_escape = session, meta_of(entity), tuple(scopes), scoped, scopes_escape
        self.steps: tuple = ()
        self.orders: tuple = ()
        self.raw_orders: tuple = ()
        self.max_rows: int | None = None
        self.skip_rows: int | None = None
        self.is_distinct = False

    def _with(self, **changes: Any) -> Query:
        new = copy.copy(self)
        vars(new).update(changes)
        return new

    def _step(self, *step: Any) -> Query:
        return self._with(steps=(*self.steps, step))

    # conditions

    def where(self, cond: Condition | Column) -> Query:
        return self._step("and", cond)

    def or_where(self, cond: Condition | Column) -> Query:
        """OR with all conditions so far."""
        return self._step("or", cond)

    def where_has(self, rel: Any, cond: Condition | None = None) -> Query:
        return self._step("exists", rel, cond, False)

    def doesnt_have(self, rel: Any, cond: Condition | None = None) -> Query:
        return self._step("exists", rel, cond, True)

    def or_where_has(self, rel: Any, cond: Condition | None = None) -> Query:
        return self.or_where(lambda c: c.where_has(rel, cond))

    def or_doesnt_have(self, rel: Any, cond: Condition | None = None) -> Query:
        return self.or_where(lambda c: c.doesnt_have(rel, cond))

    def has(self, rel: Any, test: Callable[[Column], Column], cond: Condition | None = None) -> Query:
        """Compares the number of related rows: ``has(orders, lambda n: n >= 2)``."""
        return self._step("count", rel, test, cond)

    # order and extent

    def order_by(self, key: Callable[[Any], Column], descending: bool = False, nulls: str | None = None) -> Query:
        return self._with(orders=(*self.orders, (key, descending, nulls)))

    def order_by_raw(self, sql: str, **values: Any) -> Query:
        """One key: an expression, then ASC or DESC, then NULLS FIRST or NULLS LAST."""
        m = _ORDER.fullmatch(bound(sql, values).strip())
        return self._with(raw_orders=(*self.raw_orders, (m[1], (m[2] or "").lower() == "desc", m[3] and m[3].lower())))

    def limit(self, n: int) -> Query:
        return self._with(max_rows=_not_negative(n, "limit"))

    def offset(self, n: int) -> Query:
        return self._with(skip_rows=_not_negative(n, "offset"))

    def distinct(self) -> Query:
        return self._with(is_distinct=True)

    def lock_for_update(self) -> Query:
        """Spark reads without locks, also from databases that have them."""
        self.session.dialect.require("row_locks")
        raise CapabilityError("rows are not locked from Spark; use Session.transact(), which holds the store's lock")

    for_share = lock_for_update

    # lowering

    def columns(self, alias: str = ROOT) -> Cond:
        return Cond(self.session, self.meta, alias, self.scoped)

    def _test(self, cond: Condition | Column, alias: str) -> Column:
        return cond if isinstance(cond, Column) else cond(self.columns(alias))

    def filtered(self, alias: str = ROOT) -> DataFrame:
        """All conditions, under ``alias``. Without OR each step is a filter or join of its own, so
        EXISTS becomes a semi join; with OR they become one condition."""
        rows = self.session.table(self.meta).alias(alias)
        tests = [t for s in self.scopes for t in s.conditions(self.columns(alias))]
        if not any(s[0] == "or" for s in self.steps):
            for test in tests:
                rows = rows.where(test)
            for step in self.steps:
                rows = self._narrowed(rows, step, alias)
            return rows
        found: Column | None = None
        if self.scopes_escape:
            for test in tests:
                found = test if found is None else found & test
        else:
            for test in tests:
                rows = rows.where(test)
        for step in self.steps:
            test = self._as_column(step, alias)
            if found is None:
                found = test
            else:
                found = found | test if step[0] == "or" else found & test
        return rows.where(found)

    def _narrowed(self, rows: DataFrame, step: tuple, alias: str) -> DataFrame:
        kind, *parts = step
        if kind == "exists":
            rel, cond, negated = parts
            return with_semi(rows, alias, self.session, rel, cond, self.scoped, negated)
        if kind == "count":
            rel, test, cond = parts
            joined, n = with_counts(rows, alias, self.session, rel, cond, self.scoped, "_n")
            return joined.where(test(n)).select(F.col(f"{alias}.*")).alias(alias)
        return rows.where(self._test(parts[0], alias))

    def _as_column(self, step: tuple, alias: str) -> Column:
        kind, *parts = step
        if kind == "exists":
            found = exists_column(self.session, parts[0], alias, parts[1], self.scoped)
            return ~found if parts[2] else found
        if kind == "count":
            return self.columns(alias).has(parts[0], parts[1], parts[2])
        return self._test(parts[0], alias)

    def order_keys(self, alias: str = ROOT) -> list[Column]:
        """The query's own keys, then raw ones, then those of the scopes."""
        columns = self.columns(alias)
        own = [ordered(key(columns), down, nulls) for key, down, nulls in self.orders]
        return own + [ordered(F.expr(x), down, nulls) for x, down, nulls in self.raw_orders] + [o for s in self.scopes for o in s.orderings(columns)]

    def arranged(self, rows: DataFrame, alias: str = ROOT) -> DataFrame:
        keys = self.order_keys(alias)
        return sliced(rows.orderBy(*keys) if keys else rows, self.skip_rows, self.max_rows)

    def selected(self, alias: str = ROOT) -> DataFrame:
        """Filtered, distinct, ordered and sliced rows, still under ``alias``."""
        rows = self.filtered(alias)
        if self.is_distinct:
            rows = rows.select(F.col(f"{alias}.*")).distinct().alias(alias)
        return self.arranged(rows, alias)

    def df(self) -> DataFrame:
        return self.selected().select(*[F.col(f"{ROOT}.`{c}`") for c in self.meta.columns])

    # results

    def run(self) -> list:
        with self.session.logger.timed(f"query on {self.meta.table}"):
            return [self.meta.record(r) for r in self.df().collect()]

    def iterate(self) -> Iterator:
        return records(self.df(), self.meta.record)

    def first(self) -> Any:
        return next(iter(self.limit(1).run()), None)

    def first_or_fail(self) -> Any:
        found = self.first()
        if found is None:
            raise NotFound(f"no row in {self.meta.table}")
        return found

    def count_df(self, column: Callable[[Any], Column] | None = None, name: str = "count") -> DataFrame:
        """Counts look at the conditions only, not at limit, offset, distinct or order."""
        return self.filtered().agg((F.count("*") if column is None else F.count(column(self.columns()))).alias(name))

    def count(self, column: Callable[[Any], Column] | None = None) -> int:
        return self.count_df(column).first()[0]

    def aggregate(self, **makes: Callable[[Any], Column]) -> DataFrame:
        return self.filtered().agg(*[make(self.columns()).alias(name) for name, make in makes.items()])

    def sum(self, column: Callable[[Any], Column]) -> Any:
        return self.aggregate(v=lambda c: F.sum(column(c))).first()[0]

    def avg(self, column: Callable[[Any], Column]) -> float | None:
        return self.aggregate(v=lambda c: F.avg(column(c)).cast("double")).first()[0]

    def min(self, column: Callable[[Any], Column]) -> Any:
        return self.aggregate(v=lambda c: F.min(column(c))).first()[0]

    def max(self, column: Callable[[Any], Column]) -> Any:
        return self.aggregate(v=lambda c: F.max(column(c))).first()[0]

    def exists(self) -> bool:
        return not self.filtered().isEmpty()

    def save(self, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
        """Writes the rows from the executors."""
        with self.session.logger.timed(f"save of {self.meta.table}"):
            self.df().write.format(format).mode(mode).partitionBy(*partition_by).save(path)

    def statements(self) -> list[str]:
        """The plan that Spark runs, as text."""
        return [self.df()._jdf.queryExecution().optimizedPlan().toString()]

    def explain(self) -> str:
        return self.df()._jdf.queryExecution().toString()

    def tables(self) -> list[str]:
        """The tables that the query reads, the root's first."""
        found = [self.meta.table]
        for step in self.steps:
            rel = step[1] if step[0] in ("exists", "count") else None
            for meta in (getattr(rel, "middle", None), getattr(getattr(rel, "outer", None), "target", None), getattr(rel, "target", None)):
                if meta is not None:
                    found.append(meta.table)
            if getattr(rel, "table", None):
                found.append(rel.table)
        return list(dict.fromkeys(found))

    def debug(self, rows: int = 20) -> Query:
        """Prints the plan, the first rows of each table that the query reads, and its own."""
        print(self.explain())
        for name in self.tables():
            print(name)
            self.session.frame(name).show(rows)
        self.df().show(rows)
        return self

    # other shapes

    def select(self, make: Callable[[Any], dict[str, Column]]) -> ProjectedQuery:
        """Named columns. Only the conditions carry over; order and extent belong after it."""
        return ProjectedQuery(self.filtered(), self.columns(), make)

    def join(self, rel: Relation, how: str = "inner") -> JoinedQuery:
        return JoinedQuery(self).join(rel, how)

    def left_join(self, rel: Relation) -> JoinedQuery:
        return self.join(rel, "left")

    def right_join(self, rel: Relation) -> JoinedQuery:
        return self.join(rel, "right")

    def cross_join(self, entity: Any) -> JoinedQuery:
        return JoinedQuery(self).cross_join(entity)

    def with_related(self, rel: Any, cond: Condition | None = None) -> EagerQuery:
        return EagerQuery(self).with_related(rel, cond)

    def with_related_and_pivot(self, rel: Any, cond: Condition | None = None, pivot: Callable | None = None) -> EagerQuery:
        return EagerQuery(self).with_related_and_pivot(rel, cond, pivot)

    def with_count(self, rel: Any, cond: Condition | None = None, name: str = "n_related") -> CountQuery:
        return CountQuery(self, rel, cond, name)

    def paginate(self, page: int, per_page: int) -> OffsetPage:
        if page < 1 or per_page < 1:
            raise DefinitionError("page and per_page start at 1")
        items = self.offset((page - 1) * per_page).limit(per_page).run()
        return OffsetPage(items, self.count(), page, per_page)

    def keyset_paginate(self, per_page: int) -> KeysetPaginator:
        return KeysetPaginator(self, per_page)

    def chunk(self, size: int) -> Iterator[list]:
        """Lists of at most ``size`` records, from one ordered plan."""
        return chunks(self.iterate(), size)

    # changes; they pass by hooks and soft deletes, as plain statements do

    def _store(self):
        if self.session.store is None:
            raise CapabilityError("changes need a session with a store")
        return self.session.store

    def _change(self, to: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites the files with rows that the conditions select; returns how many rows these are."""
        return self._store().rewrite(self.meta.table, lambda rows: rows.alias(ROOT).where(self._condition()), to)

    def _returned(self, values: dict[str, Column] | None) -> list:
        """The selected rows as records, after the assignments if there are any."""
        rows = self.session.table(self.meta).alias(ROOT).where(self._condition())
        kinds = {f.column: f.kind.spark for f in self.meta.fields}
        made = {c: (values or {}).get(c, F.col(f"{ROOT}.`{c}`")).cast(kinds[c]).alias(c) for c in self.meta.columns}
        return [self.meta.record(r) for r in rows.select(*made.values()).collect()]

    def _condition(self) -> Column:
        """All conditions as one column over the bare table."""
        found = F.lit(True)
        for step in self.steps:
            test = self._as_column(step, ROOT)
            found = found | test if step[0] == "or" and step is not self.steps[0] else (test if step is self.steps[0] else found & test)
        for scope in self.scopes:
            for test in scope.conditions(self.columns()):
                found = found & test
        return found

    def update(self, **values: Any) -> int:
        kinds = {self.meta.column(k): v for k, v in values.items()}
        return self.update_expr({k: v if isinstance(v, Column) else F.lit(v) for k, v in kinds.items()})

    def update_expr(self, values: dict[str, Column | str]) -> int:
        """Assignments as columns or SQL text."""
        made = {self.meta.column(k): F.expr(v) if isinstance(v, str) else v for k, v in values.items()}
        return self._change(lambda rows: dml.updated(rows.alias(ROOT), self._condition(), made))

    def update_returning(self, **values: Any) -> list:
        """Like ``update``, but returns the changed records as they are afterwards."""
        made = {self.meta.column(k): v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
        with self._store().transaction():
            found = self._returned(made)
            self.update_expr(made)
        return found

    # changes by record: the record's key picks the row among those that the query selects

    def _of(self, record: Any) -> Query:
        found = self
        for column, value in zip(self.meta.keys, self.meta.key_of(record), strict=True):
            found = found.where(F.col(f"{ROOT}.`{column}`") == F.lit(value))
        return found

    def _typed(self, values: dict[str, Any]) -> dict[str, Column]:
        return {c: F.lit(v).cast(self.meta.by_column[c].kind.spark) for c, v in values.items() if c not in self.meta.keys}

    def update_record(self, record: Any) -> int:
        return self._of(record).update_expr(self._typed(self.meta.values(record)))

    def update_partial(self, before: Any, record: Any) -> int:
        """Writes the columns that differ."""
        if self.meta.key_of(before) != self.meta.key_of(record):
            raise DefinitionError("both records must have the same key")
        old = self.meta.values(before)
        changed = {c: v for c, v in self.meta.values(record).items() if v != old.get(c)}
        return self._of(record).update_expr(self._typed(changed)) if changed else 0

    def delete_record(self, record: Any) -> int:
        return self._of(record).delete()

    def upsert_by_pk(self, record: Any) -> None:
        """The record takes the place of the row with its key, whatever the query's conditions."""
        values = self.meta.values(record)
        new = self.session.spark.createDataFrame([tuple(values.get(c) for c in self.meta.columns)], self.meta.schema)
        keys = new.select(*self.meta.keys)
        self._store().rewrite(
            self.meta.table, lambda rows: rows.join(keys, self.meta.keys, "left_semi"),
            lambda rows: dml.replaced(rows, new, self.meta.keys), lambda rows: dml.added(rows, new, self.meta.keys),
        )

    def truncate(self) -> None:
        """All rows of the table go."""
        with self._store().transaction():
            schema = self._store().schema(self.meta.table)
            self._store().write(self.meta.table, self.session.spark.createDataFrame([], schema), schema)

    def delete_returning(self) -> list:
        """Like ``delete``, but returns the records that went."""
        with self._store().transaction():
            found = self._returned(None)
            self.delete()
        return found

    def batch_update(self, rows: list[dict[str, Any]], on: list[str], assign: dict[str, Column | str] | None = None) -> BatchResult:
        """One rewrite for many parameter sets: each set of ``rows`` changes the selected rows that agree
        with it in the columns ``on``. Assignments name the set's values ``new.x`` and the row's
        ``old.x``; by default every other value is assigned. Of sets with equal keys the last counts."""
        if not rows:
            return BatchResult([])
        on = [self.meta.column(c) for c in on]
        names = [self.meta.column(k) for k in rows[0]]
        kinds = {f.column: f.kind.spark for f in self.meta.fields}
        sets = {tuple(r[k] for k in rows[0] if self.meta.column(k) in on): tuple(r[k] for k in rows[0]) for r in rows}
        new = self.session.spark.createDataFrame(list(sets.values()), T.StructType([T.StructField(c, kinds[c]) for c in names]))
        made = {self.meta.column(k): F.expr(v) if isinstance(v, str) else v for k, v in (assign or {c: F.col(f"new.`{c}`") for c in names if c not in on}).items()}
        chosen = lambda frame: frame.alias(ROOT).where(self._condition())
        with self._store().transaction():
            hits = chosen(self.session.table(self.meta)).join(new.select(*on), on, "left_semi").groupBy(*on).count().collect()
            counts = {tuple(r[c] for c in on): r["count"] for r in hits}  # at most a row a set

            def to(frame: DataFrame) -> DataFrame:
                marked = frame.alias(ROOT).select("*", dml.holds(self._condition()).alias("_hit")).alias("old")
                test = F.col("old._hit")
                for c in on:
                    test = test & (F.col(f"old.`{c}`") == F.col(f"new.`{c}`"))
                joined = marked.join(F.broadcast(new).alias("new"), test, "left")
                hit = F.col(f"new.`{on[0]}`").isNotNull()
                return joined.select(*[F.when(hit, made[c].cast(kinds[c])).otherwise(F.col(f"old.`{c}`")).alias(c) if c in made else F.col(f"old.`{c}`") for c in frame.columns])

            self.session.store.rewrite(self.meta.table, lambda frame: chosen(frame).join(new.select(*on), on, "left_semi"), to)
        order = [k for k in rows[0] if self.meta.column(k) in on]
        return BatchResult([counts.get(tuple(r[k] for k in sorted(order, key=lambda k: on.index(self.meta.column(k)))), 0) for r in rows])

    def increment(self, column: str, by: Any = 1) -> int:
        name = self.meta.column(column)
        return self.update_expr({name: F.col(name) + by})

    def decrement(self, column: str, by: Any = 1) -> int:
        return self.increment(column, -by)

    def touch(self) -> int:
        column = self.meta.marked("updated_at")
        if not column:
            raise DefinitionError(f"{self.meta.table} has no updated_at column")
        return self.update_expr({column: F.current_timestamp()})

    def delete(self) -> int:
        return self._change(lambda rows: dml.deleted(rows.alias(ROOT), self._condition()))


@dataclass(frozen=True)
class BatchResult:
    """Rows that each parameter set of a batch changed."""

    counts: list[int]

    @property
    def total(self) -> int:
        return sum(self.counts)


class CountQuery:
    """Records with the number of their related rows."""

    def __init__(self, query: Query, rel: Any, cond: Condition | None, name: str):
        self.query, self.rel, self.cond, self.name = query, rel, cond, name

    def df(self) -> DataFrame:
        """With a limit the records are chosen first, and only their related rows are counted."""
        q = self.query
        rows = q.filtered()
        if q.is_distinct:
            rows = rows.select(F.col(f"{ROOT}.*")).distinct().alias(ROOT)
        if q.max_rows is None:
            joined, n = with_counts(rows, ROOT, q.session, self.rel, self.cond, q.scoped, "_n")
            return q.arranged(joined).select(*[F.col(f"{ROOT}.`{c}`") for c in q.meta.columns], n.alias(self.name))
        chosen = numbered_rows(q.arranged(rows), ROOT, q.meta.columns)
        found = related(q.session, self.rel, self.cond, q.scoped)
        joined = chosen.join(found.rows, F.col(f"{ROOT}.`{found.source_key}`") == found.key, "left")
        counted = joined.groupBy(F.col(f"{ROOT}.{ROW}")).agg(*[F.first(F.col(f"{ROOT}.`{c}`")).alias(c) for c in q.meta.columns], F.count(found.key).alias("_n")).alias(ROOT)
        keys = q.order_keys()
        counted = counted.orderBy(*keys) if keys else counted
        return counted.select(*[F.col(f"{ROOT}.`{c}`") for c in q.meta.columns], F.col(f"{ROOT}._n").alias(self.name))

    def statements(self) -> list[str]:
        return [self.df()._jdf.queryExecution().optimizedPlan().toString()]

    def run(self) -> list[tuple]:
        return [(self.query.meta.record(r), r[self.name]) for r in self.df().collect()]

    def first(self) -> tuple | None:
        return next(iter(CountQuery(self.query.limit(1), self.rel, self.cond, self.name).run()), None)


def sliced(rows: DataFrame, skip: int | None, most: int | None) -> DataFrame:
    rows = rows.offset(skip) if skip else rows
    return rows if most is None else rows.limit(most)


def _not_negative(n: int, what: str) -> int:
    if n < 0:
        raise DefinitionError(f"{what} must not be negative")
    return n


def lazy_load(session: Session, record: Any, rel: Any, scoped: bool = False) -> list:
    """Related records of one record."""
    value = getattr(record, record.meta.by_column[related(session, rel, None, scoped).source_key].attr)
    if value is None:
        return []
    return [rel.target.record(r) for r in lazy_rows(session, rel, value, scoped).collect()]


def lazy_rows(session: Session, rel: Any, value: Any, scoped: bool = False) -> DataFrame:
    rows, key, alias, _ = target_rows(session, rel, None, scoped)
    return rows.where(key == F.lit(value)).select(*[F.col(f"`{alias}`.`{c}`") for c in rel.target.columns])
