"""Joins along relationships: every table under an alias of its own."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import ordered
from ..model import DefinitionError, NotFound
from ..relations import Relation, meta_of
from .exists import Cond
from .projection import ProjectedQuery

if TYPE_CHECKING:
    from .query import Query


class JoinedQuery:
    """Tables ``t0``, ``t1``, ... in the order of joining. Scopes of joined tables go into ON, so a
    left join keeps its rows."""

    def __init__(self, root: Query):
        self.root, self.session = root, root.session
        self.joined: tuple = ()
        self.steps: tuple = ()
        self.orders: tuple = ()
        self.max_rows, self.skip_rows = root.max_rows, root.skip_rows

    def _with(self, **changes: Any) -> JoinedQuery:
        new = copy.copy(self)
        vars(new).update(changes)
        return new

    # tables

    @property
    def metas(self) -> list:
        return [self.root.meta, *[meta for meta, _, _, _ in self.joined]]

    def join(self, rel: Relation, how: str = "inner", source: int | None = None) -> JoinedQuery:
        """``source`` picks the table to join from where several are of the same entity."""
        if not isinstance(rel, Relation):
            raise DefinitionError("joins follow belongs_to, has_one and has_many")
        at = source if source is not None else next((k for k, m in enumerate(self.metas) if m.table == rel.source.table), None)
        if at is None:
            raise DefinitionError(f"{rel.source.table} is not part of the join")
        return self._with(joined=(*self.joined, (rel.target, how, rel, at)))

    def left_join(self, rel: Relation, source: int | None = None) -> JoinedQuery:
        return self.join(rel, "left", source)

    def right_join(self, rel: Relation, source: int | None = None) -> JoinedQuery:
        return self.join(rel, "right", source)

    def cross_join(self, entity: Any) -> JoinedQuery:
        return self._with(joined=(*self.joined, (meta_of(entity), "cross", None, 0)))

    def of(self, entity: Any, nth: int = 0) -> Cond:
        """The columns of the ``nth`` table of an entity."""
        found = [k for k, m in enumerate(self.metas) if m.table == meta_of(entity).table]
        if nth >= len(found):
            raise DefinitionError(f"{meta_of(entity).table} is not part of the join")
        return self.at(found[nth])

    def at(self, index: int) -> Cond:
        return Cond(self.session, self.metas[index], f"t{index}", self.root.scoped)

    # clauses; each function gets this query, for ``j.of(Entity).column``

    def where(self, test: Callable[[JoinedQuery], Column]) -> JoinedQuery:
        return self._with(steps=(*self.steps, ("and", test)))

    def or_where(self, test: Callable[[JoinedQuery], Column]) -> JoinedQuery:
        return self._with(steps=(*self.steps, ("or", test)))

    def order_by(self, key: Callable[[JoinedQuery], Column], descending: bool = False, nulls: str | None = None) -> JoinedQuery:
        return self._with(orders=(*self.orders, (key, descending, nulls)))

    def limit(self, n: int) -> JoinedQuery:
        if n < 0:
            raise DefinitionError("limit must not be negative")
        return self._with(max_rows=n)

    def offset(self, n: int) -> JoinedQuery:
        if n < 0:
            raise DefinitionError("offset must not be negative")
        return self._with(skip_rows=n)

    # lowering

    def filtered(self) -> DataFrame:
        # a later OR is an alternative to the root's conditions too: then they are judged after the joins
        late = any(kind == "or" for kind, _ in self.steps) and bool(self.root.steps)
        rows = (self.root._with(steps=()) if late else self.root).filtered("t0")
        if self.root.is_distinct:
            rows = rows.select(F.col("t0.*")).distinct().alias("t0")
        for k, (meta, how, rel, at) in enumerate(self.joined, 1):
            other = self.session.table(meta).alias(f"t{k}")
            if rel is None:
                rows = rows.crossJoin(other)
                continue
            on = F.col(f"t{at}.`{rel.source_key}`") == F.col(f"t{k}.`{rel.target_key}`")
            if self.root.scoped:
                for scope in self.session.scopes_of(meta):
                    for test in scope.conditions(self.at(k)):
                        on = on & test
            rows = rows.join(other, on, how)
        tests = [(step[0], self.root._as_column(step, "t0")) for step in (self.root.steps if late else ())]
        found: Column | None = None
        for kind, own in [*tests, *[(kind, test(self)) for kind, test in self.steps]]:
            found = own if found is None else found | own if kind == "or" else found & own
        return rows if found is None else rows.where(found)

    def df(self) -> DataFrame:
        """A struct column for each table; an unmatched side is null."""
        rows = self.filtered()
        keys = self.root.order_keys("t0") + [ordered(key(self), down, nulls) for key, down, nulls in self.orders]
        rows = rows.orderBy(*keys) if keys else rows
        rows = rows.offset(self.skip_rows) if self.skip_rows else rows
        rows = rows if self.max_rows is None else rows.limit(self.max_rows)
        return rows.select(*[
            F.when(F.col(f"t{k}.`{m.key}`").isNotNull(), F.struct(*[F.col(f"t{k}.`{c}`") for c in m.columns])).alias(f"t{k}") for k, m in enumerate(self.metas)
        ])

    def select(self, make: Callable[[JoinedQuery], dict[str, Column]]) -> ProjectedQuery:
        return ProjectedQuery(self.filtered(), self, make)

    def run(self) -> list[tuple]:
        with self.session.logger.timed(f"join from {self.root.meta.table}"):
            return [tuple(None if v is None else m.record(v) for v, m in zip(row, self.metas, strict=True)) for row in self.df().collect()]

    def first(self) -> tuple | None:
        return next(iter(self.limit(1).run()), None)

    def first_or_fail(self) -> tuple:
        found = self.first()
        if found is None:
            raise NotFound(f"no row in the join from {self.root.meta.table}")
        return found

    def count_df(self, name: str = "count") -> DataFrame:
        return self.filtered().agg(F.count("*").alias(name))

    def count(self) -> int:
        return self.count_df().first()[0]

    def exists(self) -> bool:
        return not self.filtered().isEmpty()
