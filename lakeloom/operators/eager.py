"""Eager loading: children are gathered per parent before they are joined to it."""

from __future__ import annotations

import copy
from collections.abc import Callable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Columns, DefinitionError
from ..relations import Composed, Pivot, Relation, Through
from .exists import Condition, fresh, scoped_table

if TYPE_CHECKING:
    from ..sources.session import Session


def target_rows(session: Session, rel: Any, cond: Condition | None, scoped: bool, pivot: Callable | None = None) -> tuple[DataFrame, Column, str, str]:
    """Target rows joined to what names their parent, that key, and the aliases of the target and of
    what lies between."""
    a, b = fresh("e"), fresh("m")
    target = scoped_table(session, rel.target, a, cond, scoped)
    if isinstance(rel, Relation):
        return target, F.col(f"`{a}`.`{rel.target_key}`"), a, b
    if isinstance(rel, Pivot):
        middle = (session.table(rel.pivot) if rel.pivot else session.frame(rel.table).select(rel.source_fk, rel.target_fk)).alias(b)
        if pivot:
            middle = middle.where(pivot(Columns(rel.pivot, b)))
        return middle.join(target, F.col(f"`{b}`.`{rel.target_fk}`") == F.col(f"`{a}`.`{rel.target_key}`")), F.col(f"`{b}`.`{rel.source_fk}`"), a, b
    if isinstance(rel, Through):
        middle = scoped_table(session, rel.middle, b, None, scoped)
        return middle.join(target, F.col(f"`{b}`.`{rel.middle.key}`") == F.col(f"`{a}`.`{rel.target_fk}`")), F.col(f"`{b}`.`{rel.middle_fk}`"), a, b
    if isinstance(rel, Composed):
        middle = scoped_table(session, rel.outer.target, b, None, scoped)
        return middle.join(target, F.col(f"`{b}`.`{rel.inner.source_key}`") == F.col(f"`{a}`.`{rel.inner.target_key}`")), F.col(f"`{b}`.`{rel.outer.target_key}`"), a, b
    raise DefinitionError(f"{rel!r} is no relationship")


#: Numbers chosen records while their related rows are joined.
ROW = "_row"


def numbered_rows(rows: DataFrame, alias: str, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col(f"{alias}.`{c}`") for c in columns], F.monotonically_increasing_id().alias(ROW)).alias(alias)


def source_key(rel: Any) -> str:
    if isinstance(rel, Through):
        return rel.source.key
    return rel.outer.source_key if isinstance(rel, Composed) else rel.source_key


class EagerQuery:
    """Records with lists of related records, one list for each relationship asked for."""

    def __init__(self, query: Any):
        self.query, self.loads = query, ()

    def _with(self, load: tuple) -> EagerQuery:
        new = copy.copy(self)
        new.loads = (*self.loads, load)
        return new

    def with_related(self, rel: Any, cond: Condition | None = None) -> EagerQuery:
        return self._with((rel, cond, None, False))

    def with_related_and_pivot(self, rel: Any, cond: Condition | None = None, pivot: Callable | None = None) -> EagerQuery:
        if not (isinstance(rel, Pivot) and rel.pivot):
            raise DefinitionError("the relationship has no pivot entity")
        return self._with((rel, cond, pivot, True))

    def df(self) -> DataFrame:
        """The root's columns, then ``related_0``, ``related_1``, ...: arrays of structs, sorted by
        the target's key. Each child side is grouped before its join, so lists do not multiply."""
        q, root = self.query, "t0"
        rows, out = q.filtered(root), [F.col(f"{root}.`{c}`") for c in q.meta.columns]
        if q.is_distinct:
            rows = rows.select(F.col(f"{root}.*")).distinct().alias(root)
        if q.max_rows is not None:
            return self._few(numbered_rows(q.arranged(rows, root), root, q.meta.columns), root)
        rows = q.arranged(rows, root).select(*out).alias(root)
        for k, load in enumerate(self.loads):
            found, key, item = self._children(load)
            grouped = found.groupBy(key.alias("_key")).agg(F.sort_array(F.collect_list(item)).alias("items")).alias(g := fresh("g"))
            rows = rows.join(grouped, F.col(f"{root}.`{source_key(load[0])}`") == F.col(f"{g}._key"), "left")
            out.append(F.coalesce(F.col(f"{g}.items"), F.array()).alias(f"related_{k}"))
        keys = q.order_keys(root)
        return (rows.orderBy(*keys) if keys else rows).select(*out)

    def _children(self, load: tuple) -> tuple[DataFrame, Column, Column]:
        """Rows of one relationship, the key of their parent, and a row as a struct."""
        rel, cond, pivot, both = load
        found, key, alias, between = target_rows(self.query.session, rel, cond, self.query.scoped, pivot)
        item = F.struct(*[F.col(f"`{alias}`.`{c}`") for c in rel.target.columns])
        if both:
            item = F.struct(item.alias("target"), F.struct(*[F.col(f"`{between}`.`{c}`") for c in rel.pivot.columns]).alias("pivot"))
        return found, key, item

    def _few(self, rows: DataFrame, root: str) -> DataFrame:
        """Under a limit the chosen records meet their children, and only these are gathered."""
        names = [*self.query.meta.columns]
        for k, load in enumerate(self.loads):
            found, key, item = self._children(load)
            joined = rows.join(found, F.col(f"{root}.`{source_key(load[0])}`") == key, "left")
            own = [F.first(F.col(f"{root}.`{c}`")).alias(c) for c in names]
            items = F.sort_array(F.collect_list(F.when(key.isNotNull(), item))).alias(f"related_{k}")
            rows = joined.groupBy(F.col(f"{root}.{ROW}").alias(ROW)).agg(*own, items).alias(root)
            names.append(f"related_{k}")
        keys = self.query.order_keys(root)
        return (rows.orderBy(*keys) if keys else rows).select(*[F.col(f"{root}.`{c}`") for c in names])

    def parts(self) -> dict[str, DataFrame]:
        """The queries that the loading consists of: the root's and those of the related rows."""
        found = {self.query.meta.table: self.query.df()}
        for k, load in enumerate(self.loads):
            rows, key, item = self._children(load)
            found[f"related_{k}"] = rows.select(key.alias("key"), item.alias("item"))
        return found

    def statements(self) -> list[str]:
        """The plan of each part, and of the whole, as text."""
        return [df._jdf.queryExecution().optimizedPlan().toString() for df in [*self.parts().values(), self.df()]]

    def run(self) -> list[tuple]:
        found = []
        for row in self.df().collect():
            lists = []
            for k, (rel, _, _, both) in enumerate(self.loads):
                items = row[f"related_{k}"]
                lists.append([(rel.target.record(i["target"]), rel.pivot.record(i["pivot"])) if both else rel.target.record(i) for i in items])
            found.append((self.query.meta.record(row), *lists))
        return found

    def first(self) -> tuple | None:
        new = copy.copy(self)
        new.query = self.query.limit(1)
        return next(iter(new.run()), None)
