"""Schema migrations over the versioned store, and verification of entities against tables.

Column and table changes rewrite the schema (and rows where needed). Constraints, defaults, generated
columns, enum types and comments are kept with the table's version: a migration checks the rows when it
adds them, and later writes keep to them. Indexes and extensions have no counterpart in Parquet and are
accepted without effect.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import KINDS, DefinitionError, EngineError, EntityMeta, spark_type
from .rawsql import Fragment, literal
from .relations import meta_of
from .sources.constraints import ConstraintViolated
from .sources.session import Session


class MigrationError(EngineError):
    pass


# columns


@dataclass(frozen=True)
class ColumnDef:
    """Columns are NOT NULL unless ``nullable()`` is said."""

    name: str
    kind: T.DataType
    is_nullable: bool = False
    options: dict = field(default_factory=dict)

    def _put(self, **options: Any) -> ColumnDef:
        return replace(self, options=self.options | options)

    def nullable(self) -> ColumnDef:
        return replace(self, is_nullable=True)

    def default(self, value: Any) -> ColumnDef:
        return self._put(default=literal(value))

    def default_expression(self, sql: str) -> ColumnDef:
        return self._put(default=sql)

    def primary_key(self) -> ColumnDef:
        return self._put(primary_key=True)

    def auto_increment(self) -> ColumnDef:
        return self._put(auto_increment=True)

    def unique(self) -> ColumnDef:
        return self._put(unique=True)

    def check(self, sql: str) -> ColumnDef:
        return self._put(check=sql)

    def enum(self, name: str) -> ColumnDef:
        """Takes only the values of an enum type."""
        return self._put(enum=name)

    def says(self) -> str:
        known = {"default": "default {}", "check": "check ({})", "generated": "generated always as ({})", "enum": "enum {}"}
        notes = [form.format(self.options[k]) for k, form in known.items() if k in self.options]
        flags = [k.replace("_", " ") for k in ("unique",) if self.options.get(k)]
        return " ".join([self.name, self.kind.simpleString(), *([] if self.is_nullable else ["not null"]), *flags, *notes])

    def comment(self, text: str) -> ColumnDef:
        return self._put(comment=text)

    def collation(self, name: str) -> ColumnDef:
        return self._put(collation=name)

    def generated_always_as(self, sql: str) -> ColumnDef:
        return self._put(generated=sql)

    def references(self, table: str, column: str = "id", on_delete: str = "no action") -> ColumnDef:
        return self._put(references=[table, column, on_delete])

    def spark(self) -> T.StructField:
        return T.StructField(self.name, self.kind, self.is_nullable, dict(self.options))


def column(name: str, kind: str | T.DataType) -> ColumnDef:
    if isinstance(kind, str):
        kind = KINDS[kind].spark if kind in KINDS else spark_type(kind)
    return ColumnDef(name, kind)


def id_column(name: str = "id") -> ColumnDef:
    return column(name, "bigint").primary_key().auto_increment()


def timestamps() -> list[ColumnDef]:
    return [column(c, "timestamp").default_expression("current_timestamp()") for c in ("created_at", "updated_at")]


def soft_delete() -> ColumnDef:
    return column("deleted_at", "timestamp").nullable()


# changes; each turns (session) into new table versions


Change = Callable[[Session], None]


def _saying(says: str) -> Callable:
    """Gives a change or alteration the text that ``pretend_statements`` shows."""
    def put(run: Callable) -> Callable:
        run.says = says
        return run

    return put


def create_table(name: str, *columns: ColumnDef | list[ColumnDef], if_not_exists: bool = False, comment: str = "") -> Change:
    fields = [c for x in columns for c in (x if isinstance(x, list) else [x])]
    if len({c.name for c in fields}) < len(fields):
        raise DefinitionError(f"{name} has a column twice")

    @_saying(f"create table {name} ({', '.join(c.says() for c in fields)})")
    def run(session: Session) -> None:
        if session.store.exists(name):
            if if_not_exists:
                return
            raise MigrationError(f"table {name} exists")
        schema = T.StructType([c.spark() for c in fields])
        session.store.write(name, session.spark.createDataFrame([], schema), schema, comment)

    return run


def drop_table(name: str, if_exists: bool = False) -> Change:
    @_saying(f"drop table {name}")
    def run(session: Session) -> None:
        if session.store.exists(name):
            session.store.drop(name)
        elif not if_exists:
            raise MigrationError(f"no table {name}")

    return run


def rename_table(old: str, new: str) -> Change:
    return _saying(f"rename table {old} to {new}")(lambda session: session.store.rename(old, new))


def raw(text: str, **values: Any) -> Change:
    """A statement: INSERT, UPDATE and DELETE change the store, others run on Spark."""
    @_saying(text)
    def run(session: Session) -> None:
        kind = text.split(None, 1)[0].upper() if text.split() else ""
        if kind in ("INSERT", "UPDATE", "DELETE"):
            session.execute(Fragment(text, values))
        else:
            session.sql(Fragment(text, values))

    return run


def _enum_change(says: str, name: str, to: Callable[[list[str] | None], list[str] | None]) -> Change:
    @_saying(says)
    def run(session: Session) -> None:
        found = session.store.enums()
        values = to(found.get(name))
        session.store.put_enums({k: v for k, v in (found | {name: values}).items() if v is not None})

    return run


def _known(values: list[str] | None, name: str) -> list[str]:
    if values is None:
        raise MigrationError(f"no enum type {name}")
    return values


def create_enum_type(name: str, *values: str) -> Change:
    def to(old: list[str] | None) -> list[str]:
        if old is not None:
            raise MigrationError(f"enum type {name} exists")
        return list(values)

    return _enum_change(f"create enum type {name} ({', '.join(values)})", name, to)


def drop_enum_type(name: str) -> Change:
    return _enum_change(f"drop enum type {name}", name, lambda old: _known(old, name) and None)


def add_enum_value(name: str, value: str) -> Change:
    return _enum_change(f"alter enum type {name} add {value}", name, lambda old: [*[v for v in _known(old, name) if v != value], value])


def rename_enum_value(name: str, old_value: str, value: str) -> Change:
    """The type's value; rows are changed by an UPDATE of their own."""
    return _enum_change(f"alter enum type {name} rename {old_value} to {value}", name, lambda old: [value if v == old_value else v for v in _known(old, name)])


def enum_values(session: Session, name: str) -> list[str]:
    return _known(session.store.enums().get(name), name)


def recorded(*what: Any) -> Change:
    """Extensions: nothing to do for Parquet."""
    return _saying(" ".join(map(str, ["extension", *what])))(lambda session: None)


create_extension = drop_extension = recorded

#: An alteration turns (rows, schema) into (rows, schema).
Alteration = Callable[[DataFrame, T.StructType], tuple[DataFrame, T.StructType]]


def alter_table(name: str, *alterations: Alteration) -> Change:
    @_saying(f"alter table {name}: {', '.join(getattr(a, 'says', 'change') for a in alterations)}")
    def run(session: Session) -> None:
        rows, schema = session.store.read(name), session.store.schema(name)
        comment = None
        for alter in alterations:
            rows, schema = alter(rows, schema)
            comment = getattr(alter, "comment", comment)
        try:
            session.store.write(name, rows, schema, comment)
        except ConstraintViolated as broken:
            raise MigrationError(str(broken)) from broken

    return run


def _edited(schema: T.StructType, name: str, edit: Callable[[T.StructField], T.StructField | None]) -> T.StructType:
    if name not in schema.names:
        raise MigrationError(f"no column {name}")
    return T.StructType([f for x in schema for f in [edit(x) if x.name == name else x] if f is not None])


def _noted(schema: T.StructType, name: str, **options: Any) -> T.StructType:
    return _edited(schema, name, lambda f: T.StructField(f.name, f.dataType, f.nullable, {k: v for k, v in (dict(f.metadata or {}) | options).items() if v is not None}))


def add_column(made: ColumnDef) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        if made.name in schema.names:
            raise MigrationError(f"column {made.name} exists")
        filled = made.options.get("default") or made.options.get("generated")
        if filled is None and not made.is_nullable and not rows.isEmpty():
            raise MigrationError(f"{made.name} needs a default or has to be nullable")
        value = F.expr(filled) if filled is not None else F.lit(None)
        return rows.withColumn(made.name, value.cast(made.kind)), T.StructType([*schema, made.spark()])

    return alter


def drop_column(name: str, if_exists: bool = False) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        if if_exists and name not in schema.names:
            return rows, schema
        return rows.drop(name), _edited(schema, name, lambda f: None)

    return alter


def rename_column(old: str, new: str) -> Alteration:
    return lambda rows, schema: (rows.withColumnRenamed(old, new), _edited(schema, old, lambda f: T.StructField(new, f.dataType, f.nullable, f.metadata)))


def alter_column_type(name: str, kind: str | T.DataType) -> Alteration:
    kind = column(name, kind).kind
    return lambda rows, schema: (rows.withColumn(name, F.col(name).cast(kind)), _edited(schema, name, lambda f: T.StructField(f.name, kind, f.nullable, f.metadata)))


def set_default(name: str, value: Any) -> Alteration:
    return lambda rows, schema: (rows, _noted(schema, name, default=literal(value)))


def drop_default(name: str) -> Alteration:
    return lambda rows, schema: (rows, _noted(schema, name, default=None))


def set_not_null(name: str) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        _must_hold(rows, F.col(name).isNotNull(), f"{name} has nulls")
        return rows, _edited(schema, name, lambda f: T.StructField(f.name, f.dataType, False, f.metadata))

    return alter


def drop_not_null(name: str) -> Alteration:
    return lambda rows, schema: (rows, _edited(schema, name, lambda f: T.StructField(f.name, f.dataType, True, f.metadata)))


def _must_hold(rows: DataFrame, test: Column, says: str) -> None:
    if not rows.where(~F.coalesce(test, F.lit(True))).isEmpty():
        raise MigrationError(says)


def _unique(rows: DataFrame, names: Sequence[str]) -> None:
    if not rows.dropna(subset=list(names)).groupBy(*names).count().where("count > 1").isEmpty():
        raise MigrationError(f"{', '.join(names)} is not unique")


def _constraint(schema: T.StructType, name: str, at: str, what: Any) -> T.StructType:
    held = dict(next((f.metadata or {}).get("constraints", {}) for f in schema if f.name == at))
    return _noted(schema, at, constraints=held | {name: what})


def add_unique(name: str, *columns: str) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        _unique(rows, columns)
        return rows, _constraint(schema, name, columns[0], ["unique", *columns])

    return alter


def add_primary_key(*columns: str) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        _unique(rows, columns)
        for c in columns:
            _must_hold(rows, F.col(c).isNotNull(), f"{c} has nulls")
            schema = _noted(schema, c, primary_key=True)
        return rows, schema

    return alter


def add_check(name: str, sql: str, at: str | None = None) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        _must_hold(rows, F.expr(sql), f"check {name} does not hold")
        return rows, _constraint(schema, name, at or schema.names[0], ["check", sql])

    return alter


def add_foreign_key(name: str, local: str, table: str, key: str = "id") -> Alteration:
    return lambda rows, schema: (rows, _constraint(schema, name, local, ["foreign key", table, key]))


def drop_constraint(name: str) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        for f in schema:
            held = dict((f.metadata or {}).get("constraints", {}))
            if name in held:
                del held[name]
                return rows, _noted(schema, f.name, constraints=held)
        raise MigrationError(f"no constraint {name}")

    return alter


def column_comment(name: str, text: str) -> Alteration:
    return lambda rows, schema: (rows, _noted(schema, name, comment=text))


def table_comment(text: str) -> Alteration:
    def alter(rows: DataFrame, schema: T.StructType):
        return rows, schema

    alter.comment = text
    return alter


def no_alteration(*_: Any, **__: Any) -> Alteration:
    """Indexes: accepted, nothing to do for Parquet."""
    return lambda rows, schema: (rows, schema)


def _named(make: Callable[..., Alteration], says: str) -> Callable[..., Alteration]:
    """An alteration that tells its name and arguments."""
    @functools.wraps(make)
    def put(*args: Any, **options: Any) -> Alteration:
        alter = make(*args, **options)
        alter.says = " ".join([says, *[a.says() if isinstance(a, ColumnDef) else a.simpleString() if isinstance(a, T.DataType) else str(a) for a in args]])
        return alter

    return put


add_column, drop_column, rename_column = _named(add_column, "add column"), _named(drop_column, "drop column"), _named(rename_column, "rename column")
alter_column_type, set_default, drop_default = _named(alter_column_type, "column type"), _named(set_default, "set default"), _named(drop_default, "drop default")
set_not_null, drop_not_null = _named(set_not_null, "set not null"), _named(drop_not_null, "drop not null")
add_unique, add_primary_key, add_check = _named(add_unique, "add unique"), _named(add_primary_key, "add primary key"), _named(add_check, "add check")
add_foreign_key, drop_constraint = _named(add_foreign_key, "add foreign key"), _named(drop_constraint, "drop constraint")
drop_foreign_key, column_comment, table_comment = drop_constraint, _named(column_comment, "comment on"), _named(table_comment, "comment")
add_index, drop_index = _named(no_alteration, "add index"), _named(no_alteration, "drop index")
drop_index_if_exists, drop_index_concurrently, rename_index = drop_index, drop_index, _named(no_alteration, "rename index")


# running them


@dataclass(frozen=True)
class Migration:
    version: str
    name: str
    up: Sequence[Change]
    down: Sequence[Change] = ()

    @property
    def key(self) -> str:
        return f"{self.version}_{self.name}"


class Migrator:
    """Applies migrations in the order of their versions; each call of ``migrate`` is a batch."""

    TABLE = "migrations"
    SCHEMA = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("migration", T.StringType()), T.StructField("batch", T.IntegerType()), T.StructField("applied_at", T.TimestampType())]
    )

    def __init__(self, session: Session, migrations: Iterable[Migration], now: Callable[[], dt.datetime] = dt.datetime.now):
        self.session, self.now = session, now
        self.migrations = sorted(migrations, key=lambda m: m.version)
        if len({m.version for m in self.migrations}) < len(self.migrations):
            raise MigrationError("two migrations have one version")

    def _applied(self) -> list:
        store = self.session.store
        return store.read(self.TABLE).orderBy("id").collect() if store.exists(self.TABLE) else []

    def _note(self, rows: list) -> None:
        self.session.store.write(self.TABLE, self.session.spark.createDataFrame(rows, self.SCHEMA), self.SCHEMA)

    def pending(self) -> list[Migration]:
        done = {r["migration"] for r in self._applied()}
        return [m for m in self.migrations if m.key not in done]

    def status(self) -> list[tuple[str, int | None]]:
        done = {r["migration"]: r["batch"] for r in self._applied()}
        return [(m.key, done.get(m.key)) for m in self.migrations]

    pretend = pending

    def pretend_statements(self) -> list[str]:
        """What ``migrate`` would do, without doing it."""
        return [getattr(change, "says", "a change without a name") for m in self.pending() for change in m.up]

    def migrate(self, in_one: bool = True) -> list[str]:
        """All pending migrations, in one transaction or each in its own."""
        todo = self.pending()
        batch = max([r["batch"] for r in self._applied()], default=0) + 1
        if not in_one:
            for m in todo:
                with self.session.transact():
                    self._up([m], batch)
        elif todo:
            with self.session.transact():
                self._up(todo, batch)
        return [m.key for m in todo]

    def _up(self, todo: list[Migration], batch: int) -> None:
        for m in todo:
            for change in m.up:
                change(self.session)
            rows = [tuple(r) for r in self._applied()]
            self._note([*rows, (max([r[0] for r in rows], default=0) + 1, m.key, batch, self.now())])

    def _down(self, rows: list) -> list[str]:
        by_key = {m.key: m for m in self.migrations}
        with self.session.transact():
            for row in reversed(rows):
                if row["migration"] not in by_key:
                    raise MigrationError(f"{row['migration']} is unknown")
                for change in by_key[row["migration"]].down:
                    change(self.session)
            gone = {r["migration"] for r in rows}
            self._note([tuple(r) for r in self._applied() if r["migration"] not in gone])
        return [r["migration"] for r in reversed(rows)]

    def rollback(self) -> list[str]:
        """Undoes the last batch."""
        applied = self._applied()
        return self.rollback_batch(max(r["batch"] for r in applied)) if applied else []

    def rollback_batch(self, batch: int) -> list[str]:
        return self._down([r for r in self._applied() if r["batch"] == batch])

    def rollback_steps(self, n: int) -> list[str]:
        return self._down(self._applied()[-n:]) if n > 0 else []

    def reset(self) -> list[str]:
        return self._down(self._applied())


# verification


@dataclass(frozen=True)
class Issue:
    kind: str
    table: str
    column: str
    detail: str

    @property
    def warning(self) -> bool:
        return self.kind in ("nullability_mismatch", "extra_column")


def verify(session: Session, *entities: Any) -> list[Issue]:
    """Differences between entities and the tables that the session finds."""
    found: list[Issue] = []
    for meta in map(meta_of, entities):
        schema = _schema_of(session, meta)
        if schema is None:
            found.append(Issue("table_missing", meta.table, "", ""))
            continue
        fields = {f.name: f for f in schema}
        for f in meta.fields:
            there = fields.get(f.column)
            if there is None:
                found.append(Issue("column_missing", meta.table, f.column, f.kind.spark.simpleString()))
            elif there.dataType != f.kind.spark:
                found.append(Issue("type_mismatch", meta.table, f.column, f"{f.kind.spark.simpleString()}, found {there.dataType.simpleString()}"))
            elif session.store is not None and there.nullable != f.nullable and not f.pk:
                found.append(Issue("nullability_mismatch", meta.table, f.column, f"nullable {f.nullable}, found {there.nullable}"))
        found += [Issue("extra_column", meta.table, c, "") for c in fields if c not in meta.columns]
        keys = [c for c, f in fields.items() if (f.metadata or {}).get("primary_key")]
        if keys and sorted(keys) != sorted(meta.keys):
            found.append(Issue("primary_key_mismatch", meta.table, ",".join(meta.keys), f"found {','.join(keys)}"))
    return found


def _schema_of(session: Session, meta: EntityMeta) -> T.StructType | None:
    if session.store is not None and session.store.exists(meta.table):
        return session.store.schema(meta.table)
    try:
        return session.frame(meta.table).schema
    except Exception as missing:  # Spark has no common error for a missing table or path
        if any(x in str(missing) for x in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "no table")):
            return None
        raise


def issues_df(session: Session, *entities: Any) -> DataFrame:
    rows = [(i.kind, i.table, i.column, i.detail, i.warning) for i in verify(session, *entities)]
    return session.spark.createDataFrame(rows, "kind string, table_name string, column_name string, detail string, warning boolean")


def report(issues: Sequence[Issue]) -> str:
    """Issues as lines, errors before warnings."""
    if not issues:
        return "all tables match"
    return "\n".join(f"{'warning' if i.warning else 'error'}: {i.table}{'.' + i.column if i.column else ''}: {i.kind.replace('_', ' ')}{' (' + i.detail + ')' if i.detail else ''}" for i in sorted(issues, key=lambda i: (i.warning, i.table, i.column)))
