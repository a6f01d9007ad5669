"""Pages by offset and by key."""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import ordered
from ..model import DefinitionError

if TYPE_CHECKING:
    from .query import Query


@dataclass(frozen=True)
class OffsetPage:
    items: list
    total: int
    page: int
    per_page: int

    @property
    def total_pages(self) -> int:
        return -(-self.total // self.per_page)

    @property
    def has_next(self) -> bool:
        return self.page < self.total_pages

    @property
    def has_prev(self) -> bool:
        return self.page > 1


@dataclass(frozen=True)
class KeysetPage:
    items: list
    next_key: tuple | None
    prev_key: tuple | None
    has_more: bool


class KeysetPaginator:
    """Pages after a key. The query's conditions hold; its order and extent do not. Nulls come
    first ascending and last descending, and pages go through them."""

    def __init__(self, query: Query, per_page: int):
        if per_page < 1:
            raise DefinitionError("per_page starts at 1")
        self.query, self.per_page = query, per_page
        self.keys: tuple = ()
        self.position: tuple | None = None

    def _with(self, **changes: Any) -> KeysetPaginator:
        new = copy.copy(self)
        vars(new).update(changes)
        return new

    def asc(self, key: Callable[[Any], Column]) -> KeysetPaginator:
        return self._with(keys=(*self.keys, (key, False)))

    def desc(self, key: Callable[[Any], Column]) -> KeysetPaginator:
        return self._with(keys=(*self.keys, (key, True)))

    def after(self, *key: Any) -> KeysetPaginator:
        if len(key) == 1 and key[0] is None and len(self.keys) != 1:
            return self
        if len(key) != len(self.keys):
            raise DefinitionError("the key must have a value for each column")
        return self._with(position=key)

    def _beyond(self, columns: list[Column]) -> Column:
        """(a > x) or (a = x and b > y) or ..., each in its column's direction."""
        found, equal = F.lit(False), F.lit(True)
        for (_, down), column, value in zip(self.keys, columns, self.position, strict=True):
            if value is None:
                past = F.lit(False) if down else column.isNotNull()
            else:
                past = (column < F.lit(value)) | column.isNull() if down else column > F.lit(value)
            found = found | (equal & past)
            equal = equal & column.eqNullSafe(F.lit(value))
        return found

    def rows(self, extra: int = 0) -> DataFrame:
        if not self.keys:
            raise DefinitionError("a keyset needs at least one column")
        columns = [key(self.query.columns()) for key, _ in self.keys]
        found = self.query.filtered()
        if self.position is not None:
            found = found.where(self._beyond(columns))
        found = found.orderBy(*[ordered(c, down) for c, (_, down) in zip(columns, self.keys, strict=True)]).limit(self.per_page + extra)
        return found.select(*[F.col(f"t0.`{c}`") for c in self.query.meta.columns], *[c.alias(f"_key{k}") for k, c in enumerate(columns)])

    def df(self) -> DataFrame:
        return self.rows().select(*self.query.meta.columns)

    def run(self) -> KeysetPage:
        found = self.rows(extra=1).collect()
        page = found[: self.per_page]
        key = lambda row: tuple(row[f"_key{k}"] for k in range(len(self.keys)))
        more = len(found) > self.per_page
        return KeysetPage([self.query.meta.record(r) for r in page], key(page[-1]) if page and more else None, key(page[0]) if page and self.position is not None else None, more)
