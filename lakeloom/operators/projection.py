"""Projections: named columns, grouping, HAVING, order and extent."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import ordered
from ..model import DefinitionError, NotFound


class ProjectedQuery:
    """``make`` turns the source's columns into a dict of output columns."""

    def __init__(self, rows: DataFrame, columns: Any, make: Callable[[Any], dict[str, Column]]):
        self.rows, self.columns = rows, columns
        self.made = make(columns)
        if not isinstance(self.made, dict) or not all(isinstance(v, Column) for v in self.made.values()):
            raise DefinitionError("select needs a dict of columns")
        self.keys: tuple = ()
        self.tests: tuple = ()
        self.orders: tuple = ()
        self.max_rows: int | None = None
        self.skip_rows: int | None = None
        self.is_distinct = False

    def _with(self, **changes: Any) -> ProjectedQuery:
        new = copy.copy(self)
        vars(new).update(changes)
        return new

    def group_by(self, *keys: Callable[[Any], Column]) -> ProjectedQuery:
        return self._with(keys=(*self.keys, *keys))

    def having(self, test: Callable[[Any], Column]) -> ProjectedQuery:
        return self._with(tests=(*self.tests, ("and", test)))

    def or_having(self, test: Callable[[Any], Column]) -> ProjectedQuery:
        return self._with(tests=(*self.tests, ("or", test)))

    def order_by(self, key: str | Callable[[Any], Column], descending: bool = False, nulls: str | None = None) -> ProjectedQuery:
        """By an output column's name or by any expression, aggregates included."""
        return self._with(orders=(*self.orders, (key, descending, nulls)))

    def limit(self, n: int) -> ProjectedQuery:
        if n < 0:
            raise DefinitionError("limit must not be negative")
        return self._with(max_rows=n)

    def offset(self, n: int) -> ProjectedQuery:
        if n < 0:
            raise DefinitionError("offset must not be negative")
        return self._with(skip_rows=n)

    def distinct(self) -> ProjectedQuery:
        return self._with(is_distinct=True)

    def df(self) -> DataFrame:
        out = [c.alias(name) for name, c in self.made.items()]
        test: Column | None = None
        for kind, make in self.tests:
            own = make(self.columns)
            test = own if test is None else test | own if kind == "or" else test & own
        hidden = [test.alias("_having")] if test is not None else []
        computed = [(f"_order{k}", key(self.columns)) for k, (key, _, _) in enumerate(self.orders) if callable(key)]
        hidden += [c.alias(name) for name, c in computed]
        if self.keys:
            groups = [key(self.columns).alias(f"_key{k}") for k, key in enumerate(self.keys)]
            rows = self.rows.groupBy(*groups).agg(*out, *hidden)
        else:
            rows = self.rows.select(*out, *hidden)
        if test is not None:
            rows = rows.where("_having")
        if self.is_distinct:
            if computed:
                raise DefinitionError("a distinct projection is ordered by its own columns")
            rows = rows.select(*self.made).distinct()
        if self.orders:
            rows = rows.orderBy(*[ordered(F.col(key if isinstance(key, str) else f"_order{k}"), down, nulls) for k, (key, down, nulls) in enumerate(self.orders)])
        rows = rows.offset(self.skip_rows) if self.skip_rows else rows
        rows = rows if self.max_rows is None else rows.limit(self.max_rows)
        return rows.select(*self.made)

    def run(self) -> list:
        return self.df().collect()

    def first(self) -> Any:
        return next(iter(self.limit(1).run()), None)

    def first_or_fail(self) -> Any:
        found = self.first()
        if found is None:
            raise NotFound("the projection has no row")
        return found
