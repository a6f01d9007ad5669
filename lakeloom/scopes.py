"""Scopes: conditions, orders and write hooks that an entity carries with it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .model import DefinitionError, EntityMeta
from .relations import meta_of


class Scope:
    """Override what applies. ``key`` names the scope, so a query can leave it out."""

    key = ""

    def conditions(self, columns: Any) -> list[Column]:
        return []

    def orderings(self, columns: Any) -> list[Column]:
        return []

    def on_insert(self, meta: EntityMeta) -> dict[str, Column]:
        return {}

    def on_update(self, meta: EntityMeta) -> dict[str, Column]:
        return {}

    def rewrite_delete(self, meta: EntityMeta) -> dict[str, Column] | None:
        """Assignments that take the place of a delete, or None."""
        return None


class Where(Scope):
    """A scope of one condition."""

    def __init__(self, key: str, condition: Callable[[Any], Column], order: Callable[[Any], Column] | None = None):
        self.key, self._condition, self._order = key, condition, order

    def conditions(self, columns: Any) -> list[Column]:
        return [self._condition(columns)]

    def orderings(self, columns: Any) -> list[Column]:
        return [self._order(columns)] if self._order else []


class SoftDeletes(Scope):
    """Rows with a deletion time are hidden; deleting sets it."""

    key = "soft_deletes"

    def __init__(self, entity: Any, now: Callable[[], Column] = F.current_timestamp):
        self.column, self.now = meta_of(entity).marked("deleted_at"), now
        if not self.column:
            raise DefinitionError("soft deletes need a deleted_at column")

    def conditions(self, columns: Any) -> list[Column]:
        return [columns[self.column].isNull()]

    def rewrite_delete(self, meta: EntityMeta) -> dict[str, Column]:
        return {self.column: self.now()}


class Timestamps(Scope):
    """Creation sets both times, each update the second."""

    key = "timestamps"

    def __init__(self, entity: Any, now: Callable[[], Column] = F.current_timestamp):
        meta = meta_of(entity)
        self.created, self.updated, self.now = meta.marked("created_at"), meta.marked("updated_at"), now
        if not (self.created or self.updated):
            raise DefinitionError("timestamps need a created_at or updated_at column")

    def on_insert(self, meta: EntityMeta) -> dict[str, Column]:
        return {c: self.now() for c in (self.created, self.updated) if c}

    def on_update(self, meta: EntityMeta) -> dict[str, Column]:
        return {self.updated: self.now()} if self.updated else {}
