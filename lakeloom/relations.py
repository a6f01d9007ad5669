"""Relationships between entities: small descriptions that queries lower to joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .model import DefinitionError, EntityMeta, snake_case


def meta_of(entity: Any) -> EntityMeta:
    return entity if isinstance(entity, EntityMeta) else entity.meta


@dataclass(frozen=True)
class Relation:
    """``source.source_key = target.target_key``."""

    source: EntityMeta
    target: EntityMeta
    source_key: str
    target_key: str
    kind: str

    def via(self, inner: "Relation") -> "Composed":
        return Composed(self, inner)


@dataclass(frozen=True)
class Pivot:
    """Many to many through a table of key pairs."""

    source: EntityMeta
    target: EntityMeta
    table: str
    source_fk: str
    target_fk: str
    kind: str = "belongs_to_many"
    pivot: EntityMeta | None = None
    writable: type | None = field(default=None, compare=False)

    @property
    def source_key(self) -> str:
        return self.source.key

    @property
    def target_key(self) -> str:
        return self.target.key

    def with_pivot(self, entity: Any, creator: type | None = None) -> "Pivot":
        """Keeps the pivot rows as records of ``entity``; with a creator they can be written."""
        meta = meta_of(entity)
        if meta.table != self.table:
            raise DefinitionError(f"{meta.cls.__name__} is not the pivot table {self.table}")
        return Pivot(self.source, self.target, self.table, self.source_fk, self.target_fk, self.kind, meta, creator)


@dataclass(frozen=True)
class Through:
    """source <- middle.middle_fk, middle.key <- target.target_fk."""

    source: EntityMeta
    middle: EntityMeta
    target: EntityMeta
    middle_fk: str
    target_fk: str
    kind: str


@dataclass(frozen=True)
class Composed:
    """A has-many followed by another direct relationship."""

    outer: Relation
    inner: Relation
    kind: str = "via"

    def __post_init__(self) -> None:
        if self.outer.kind != "has_many" or self.inner.kind not in ("belongs_to", "has_one", "has_many"):
            raise DefinitionError("via composes a has_many with a direct relationship")
        if self.outer.target.table != self.inner.source.table:
            raise DefinitionError("the inner relationship must start where the outer ends")

    @property
    def source(self) -> EntityMeta:
        return self.outer.source

    @property
    def target(self) -> EntityMeta:
        return self.inner.target


def belongs_to(source: Any, target: Any, fk: str, key: str | None = None) -> Relation:
    s, t = meta_of(source), meta_of(target)
    return Relation(s, t, s.column(fk), t.column(key or t.key), "belongs_to")


def has_one(source: Any, target: Any, fk: str, key: str | None = None) -> Relation:
    s, t = meta_of(source), meta_of(target)
    return Relation(s, t, s.column(key or s.key), t.column(fk), "has_one")


def has_many(source: Any, target: Any, fk: str, key: str | None = None) -> Relation:
    s, t = meta_of(source), meta_of(target)
    return Relation(s, t, s.column(key or s.key), t.column(fk), "has_many")


def belongs_to_many(source: Any, target: Any, pivot: str | None = None, source_fk: str | None = None, target_fk: str | None = None) -> Pivot:
    """Without arguments the names follow the class names: ``student_course``, ``student_id``,
    ``course_id``."""
    s, t = meta_of(source), meta_of(target)
    a, b = snake_case(s.cls.__name__), snake_case(t.cls.__name__)
    return Pivot(s, t, pivot or f"{a}_{b}", source_fk or f"{a}_id", target_fk or f"{b}_id")


def has_many_through(source: Any, middle: Any, target: Any, middle_fk: str, target_fk: str) -> Through:
    m, t = meta_of(middle), meta_of(target)
    return Through(meta_of(source), m, t, m.column(middle_fk), t.column(target_fk), "has_many_through")


def has_one_through(source: Any, middle: Any, target: Any, middle_fk: str, target_fk: str) -> Through:
    m, t = meta_of(middle), meta_of(target)
    return Through(meta_of(source), m, t, m.column(middle_fk), t.column(target_fk), "has_one_through")
