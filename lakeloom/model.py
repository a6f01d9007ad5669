"""Entities: typed tables with explicit schemas, column names, keys and markers."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MISSING = object()


class EngineError(Exception):
    """Base of the engine's own errors."""


class DefinitionError(EngineError):
    """An entity, relationship or query is declared wrongly."""


class NotFound(EngineError):
    """A row that has to exist does not."""


class CapabilityError(EngineError):
    """The backend has no such feature."""


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def upper_snake_case(name: str) -> str:
    return snake_case(name).upper()


def same_case(name: str) -> str:
    return name


def enum_type(*values: str) -> "FieldKind":
    """A string that only takes the given values."""
    return FieldKind(T.StringType(), lambda v: _one_of(v, values), lambda v: _one_of(v, values), values)


def _one_of(value: Any, values: tuple[str, ...]) -> Any:
    if value is not None and value not in values:
        raise ValueError(f"{value!r} is not one of {', '.join(values)}")
    return value


class FieldKind:
    """A Spark type with a pair of converters between the stored and the record's value."""

    def __init__(self, spark: T.DataType, decode: Callable = same_case, encode: Callable = same_case, values: tuple[str, ...] = ()):
        self.spark, self.decode, self.encode, self.values = spark, decode, encode, values


_SIMPLE = {
    "string": T.StringType(), "boolean": T.BooleanType(), "tinyint": T.ByteType(), "smallint": T.ShortType(), "int": T.IntegerType(),
    "bigint": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "binary": T.BinaryType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(),
}


def spark_type(name: str) -> T.DataType:
    """The type of a DDL name. The usual ones need no running session."""
    if name in _SIMPLE:
        return _SIMPLE[name]
    if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    if m := re.fullmatch(r"array<(.*)>", name):
        return T.ArrayType(spark_type(m[1]))
    return T._parse_datatype_string(name)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_XY = _struct(x=T.DoubleType(), y=T.DoubleType())

#: Short names for types that Spark spells otherwise or lacks.
KINDS: dict[str, FieldKind] = {
    "uuid": FieldKind(T.StringType()), "json": FieldKind(T.StringType()), "xml": FieldKind(T.StringType()), "time": FieldKind(T.StringType()),
    "url": FieldKind(T.StringType()), "zone": FieldKind(T.StringType()), "inet": FieldKind(T.StringType()),
    "numeric": FieldKind(T.DecimalType(38, 18)), "money": FieldKind(T.DecimalType(19, 2)), "instant": FieldKind(T.TimestampType()),
    "local_timestamp": FieldKind(T.TimestampNTZType()), "interval": FieldKind(T.DayTimeIntervalType()), "months": FieldKind(T.YearMonthIntervalType()),
    "point": FieldKind(_XY), "lseg": FieldKind(_struct(a=_XY, b=_XY)), "box": FieldKind(_struct(a=_XY, b=_XY)),
    "circle": FieldKind(_struct(center=_XY, radius=T.DoubleType())), "line": FieldKind(_struct(a=T.DoubleType(), b=T.DoubleType(), c=T.DoubleType())),
    "path": FieldKind(T.ArrayType(_XY)), "polygon": FieldKind(T.ArrayType(_XY)),
}


class Field:
    """A declared column."""

    def __init__(self, kind: str | T.DataType | FieldKind, *, pk: bool = False, nullable: bool = False, name: str | None = None, default: Any = _MISSING, marker: str | None = None):
        if isinstance(kind, str):
            kind = KINDS.get(kind) or FieldKind(spark_type(kind))
        elif isinstance(kind, T.DataType):
            kind = FieldKind(kind)
        self.kind, self.pk, self.nullable, self.column, self.default, self.marker = kind, pk, nullable, name, default, marker
        self.attr = ""

    @property
    def has_default(self) -> bool:
        return self.default is not _MISSING


def field(kind: str | T.DataType | FieldKind, **options: Any) -> Any:
    return Field(kind, **options)


def created_at(kind: str = "timestamp", **options: Any) -> Any:
    return Field(kind, marker="created_at", **options)


def updated_at(kind: str = "timestamp", **options: Any) -> Any:
    return Field(kind, marker="updated_at", **options)


def deleted_at(kind: str = "timestamp", **options: Any) -> Any:
    return Field(kind, marker="deleted_at", **{"nullable": True} | options)


class EntityMeta:
    """What the engine knows of an entity: table, fields in order, keys and markers."""

    def __init__(self, cls: type, table: str, fields: list[Field]):
        self.cls, self.table, self.fields = cls, table, fields
        self.by_attr = {f.attr: f for f in fields}
        self.by_column = {f.column: f for f in fields}
        keys = [f for f in fields if f.pk]
        self.keys = [f.column for f in (keys or fields[:1])]
        self.key = self.keys[0]
        self.columns = [f.column for f in fields]
        self.schema = T.StructType([T.StructField(f.column, f.kind.spark, True) for f in fields])

    def column(self, name: str) -> str:
        found = self.by_attr.get(name) or self.by_column.get(name)
        if found is None:
            raise DefinitionError(f"{self.cls.__name__} has no column {name}")
        return found.column

    def marked(self, marker: str) -> str | None:
        return next((f.column for f in self.fields if f.marker == marker), None)

    def record(self, row: Any) -> Any:
        """A record from a Row or mapping that has the entity's columns."""
        return self.cls(**{f.attr: f.kind.decode(row[f.column]) for f in self.fields})

    def values(self, record: Any) -> dict[str, Any]:
        return {f.column: f.kind.encode(getattr(record, f.attr)) for f in self.fields if f.attr in record.__dict__}

    def key_of(self, record: Any) -> tuple:
        return tuple(getattr(record, self.by_column[k].attr, None) for k in self.keys)


class Entity:
    """Base of entities. A subclass lists its columns as ``field(...)`` attributes; ``creates``
    names the entity whose rows a creator class makes."""

    meta: EntityMeta

    def __init_subclass__(cls, table: str | None = None, names: Callable[[str], str] = same_case, creates: type | None = None, **kwargs: Any):
        super().__init_subclass__(**kwargs)
        fields = [f for base in reversed(cls.__mro__) for f in vars(base).values() if isinstance(f, Field)]
        if not fields:
            return
        for attr, f in [(a, f) for base in cls.__mro__ for a, f in vars(base).items() if isinstance(f, Field)]:
            f.attr, f.column = attr, f.column or names(attr)
        cls.meta = EntityMeta(cls, table or (creates.meta.table if creates else names(cls.__name__)), fields)
        _check_markers(cls.meta)
        if creates:
            _check_creator(cls.meta, creates.meta)

    def __init__(self, **values: Any):
        for f in self.meta.fields:
            if f.attr in values:
                setattr(self, f.attr, values.pop(f.attr))
            elif f.has_default:
                setattr(self, f.attr, f.default)
            elif f.nullable:
                setattr(self, f.attr, None)
            elif f.pk or f.marker:
                vars(self).setdefault(f.attr, None)
            else:
                raise TypeError(f"{type(self).__name__} needs {f.attr}")
        if values:
            raise TypeError(f"{type(self).__name__} has no {', '.join(values)}")

    def copy(self, **changes: Any) -> Any:
        return type(self)(**vars(self) | changes)

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    def __hash__(self) -> int:
        return hash((type(self), self.meta.key_of(self)))

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"


def _check_markers(meta: EntityMeta) -> None:
    for marker in ("created_at", "updated_at", "deleted_at"):
        found = [f for f in meta.fields if f.marker == marker]
        if len(found) > 1:
            raise DefinitionError(f"{meta.cls.__name__} has more than one {marker} column")
        if found and not isinstance(found[0].kind.spark, (T.TimestampType, T.TimestampNTZType)):
            raise DefinitionError(f"{meta.cls.__name__}.{found[0].attr} must be a timestamp")
        if found and marker == "deleted_at" and not found[0].nullable:
            raise DefinitionError(f"{meta.cls.__name__}.{found[0].attr} must be nullable")


def _check_creator(creator: EntityMeta, entity: EntityMeta) -> None:
    for f in creator.fields:
        whole = entity.by_column.get(f.column)
        if whole is None or whole.kind.spark != f.kind.spark:
            raise DefinitionError(f"{creator.cls.__name__}.{f.attr} is no column of {entity.cls.__name__} with that type")
        if whole.pk or whole.marker:
            raise DefinitionError(f"{creator.cls.__name__} must leave out {f.attr}, which the engine fills")


class Columns:
    """``cols.name``: a column of an entity, bound to the alias under which its table is read."""

    def __init__(self, meta: EntityMeta, alias: str):
        self._meta, self._alias = meta, alias

    def __getattr__(self, name: str) -> Column:
        if name.startswith("__"):
            raise AttributeError(name)
        return F.col(f"`{self._alias}`.`{self._meta.column(name)}`")

    __getitem__ = __getattr__
