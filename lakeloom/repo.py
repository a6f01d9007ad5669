"""Repositories: records of one entity, read through scopes and written with hooks and observers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import CapabilityError, DefinitionError, NotFound
from .operators import dml
from .operators.query import Query
from .relations import Pivot, meta_of
from .scopes import Scope, SoftDeletes
from .sources.session import Session

#: More ids than this are joined, not listed in the plan.
LISTED_IDS = 1_000


@dataclass
class SyncResult:
    attached: list = field(default_factory=list)
    detached: list = field(default_factory=list)
    unchanged: list = field(default_factory=list)


class Observer:
    """Called around the writes of single records; raising in a ``...ing`` event cancels the write."""

    def creating(self, record: Any) -> None: ...
    def created(self, record: Any) -> None: ...
    def updating(self, record: Any) -> None: ...
    def updated(self, record: Any) -> None: ...
    def deleting(self, record: Any) -> None: ...
    def deleted(self, record: Any) -> None: ...
    def trashed(self, record: Any) -> None: ...
    def force_deleting(self, record: Any) -> None: ...
    def force_deleted(self, record: Any) -> None: ...
    def restoring(self, record: Any) -> None: ...
    def restored(self, record: Any) -> None: ...


class Repo:
    """Subclasses and mixins may bring scopes of their own: ``injected`` ones come before those that the
    repository is made with, ``final`` ones after them, each in the order of the classes from base to
    subclass. A scope may be given as a function of the entity."""

    injected: Sequence[Scope | Callable[[Any], Scope]] = ()
    final: Sequence[Scope | Callable[[Any], Scope]] = ()

    def __init__(self, session: Session, entity: Any, scopes: Sequence[Scope] = (), observers: Sequence[Observer] = ()):
        self.session, self.meta, self.observers = session, meta_of(entity), tuple(observers)
        stacked = [*self._stacked("injected"), *scopes, *self._stacked("final")]
        self.scopes = tuple(s if isinstance(s, Scope) else s(self.meta) for s in stacked)
        self.session.scopes[self.meta.table] = self.scopes

    @classmethod
    def _stacked(cls, name: str) -> list:
        return [s for c in reversed(cls.__mro__) for s in vars(c).get(name, ())]

    # reading

    def query(self) -> Query:
        return Query(self.session, self.meta, self.scopes, scoped=True)

    def query_unscoped(self) -> Query:
        return Query(self.session, self.meta)

    def query_without(self, *keys: str) -> Query:
        return Query(self.session, self.meta, [s for s in self.scopes if s.key not in keys], scoped=True)

    def with_trashed(self) -> Query:
        return self.query_without(SoftDeletes.key)

    def only_trashed(self) -> Query:
        column = self._deleted_column()
        return self.query_without(SoftDeletes.key).where(lambda c: c[column].isNotNull())

    def find_all(self) -> list:
        return [self.session.track(self.meta, r) for r in self.query().run()]

    def count(self) -> int:
        return self.query().count()

    def _by_key(self, query: Query, key: Any) -> Query:
        values = key if isinstance(key, tuple) else (key,)
        return query.where(lambda c: _all([c[k] == F.lit(v) for k, v in zip(self.meta.keys, values, strict=True)]))

    def find(self, key: Any) -> Any:
        found = self._by_key(self.query(), key).first()
        return None if found is None else self.session.track(self.meta, found)

    def find_or_fail(self, key: Any) -> Any:
        found = self.find(key)
        if found is None:
            raise NotFound(f"no {self.meta.table} with key {key!r}")
        return found

    def exists(self, key: Any) -> bool:
        return self._by_key(self.query(), key).exists()

    def rows_by_ids(self, ids: Iterable) -> DataFrame:
        """Missing ids are passed over. Long lists become a table and a semi join."""
        ids = list(ids)
        if len(ids) <= LISTED_IDS:
            return self.query().where(lambda c: c[self.meta.key].isin(ids)).df()
        kind = self.meta.by_column[self.meta.key].kind.spark
        keys = self.session.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField(self.meta.key, kind)]))
        return self.query().df().join(keys.distinct(), self.meta.key, "left_semi")

    def _among(self, query: Query, ids: list) -> Query:
        """The rows with some of many ids, for changes: long lists become a table and EXISTS."""
        if len(ids) <= LISTED_IDS:
            return query.where(lambda c: c[self.meta.key].isin(ids))
        kind = self.meta.by_column[self.meta.key].kind.spark
        keys = self.session.spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("_id", kind)])).distinct()
        return query.where(lambda c: keys.where(F.col("_id") == c[self.meta.key].outer()).exists())

    def find_all_by_id(self, ids: Iterable) -> list:
        return [self.session.track(self.meta, self.meta.record(r)) for r in self.rows_by_ids(ids).collect()]

    def refresh(self, record: Any) -> Any:
        found = self._by_key(self.query(), self.meta.key_of(record)).first()
        if found is None:
            raise NotFound(f"{record!r} is gone")
        return found

    # change tracking

    def original(self, record: Any) -> Any:
        return self.session.original(record)

    def changes(self, record: Any) -> dict[str, Any]:
        before = self.original(record)
        return {} if before is None else {k: v for k, v in vars(record).items() if v != vars(before).get(k)}

    def is_dirty(self, record: Any) -> bool:
        return bool(self.changes(record))

    # writing

    def _store(self):
        if self.session.store is None:
            raise CapabilityError("writing needs a session with a store")
        return self.session.store

    def _frame(self, records: Sequence) -> DataFrame:
        """Records as rows; they come from the caller, so their number is bounded."""
        rows = [Row(**{"_at": k, **{c: r.meta.values(r).get(c) for c in self.meta.columns if c in r.meta.columns}}) for k, r in enumerate(records)]
        columns = [c for c in self.meta.columns if c in (records[0].meta.columns if records else self.meta.columns)]
        schema = T.StructType([T.StructField("_at", T.IntegerType()), *[T.StructField(c, self.meta.by_column[c].kind.spark) for c in columns]])
        return self.session.spark.createDataFrame([tuple(r[f.name] for f in schema) for r in rows], schema)

    def _notify(self, event: str, record: Any) -> None:
        for observer in self.observers:
            getattr(observer, event)(record)

    def _hooked(self, kind: str) -> dict[str, Column]:
        return {c: v for s in self.scopes for c, v in getattr(s, kind)(self.meta).items()}

    def _filled(self, new: DataFrame) -> DataFrame:
        """Defaults of the entity, then those of the stored table, then hook columns."""
        for f in self.meta.fields:
            if f.column not in new.columns and f.has_default:
                new = new.withColumn(f.column, F.lit(f.default).cast(f.kind.spark))
        for f in self._store().schema(self.meta.table):
            default = (f.metadata or {}).get("default")
            if default is not None and f.name not in new.columns:
                new = new.withColumn(f.name, F.expr(default).cast(f.dataType))
        for column, value in self._hooked("on_insert").items():
            new = new.withColumn(column, value)
        return new

    def raw_insert_all(self, records: Sequence) -> list:
        """Appends with hook columns and generated keys, without observers; returns the new records."""
        if not records:
            return []
        with self._store().transaction():
            new = self._filled(self._frame(records))
            old, key = self._store().read(self.meta.table), self.meta.key
            if key not in new.columns or new.where(F.col(key).isNotNull()).isEmpty():
                new = dml.numbered(old, new, key, ["_at"])
            made = self.session.spark.createDataFrame(new.orderBy("_at").drop("_at").collect(), new.drop("_at").schema)
            self._store().append(self.meta.table, dml.conformed(made, old))
        whole = dml.conformed(made, self.session.spark.createDataFrame([], self.meta.schema))
        return [self.meta.record(r) for r in whole.collect()]

    def insert_frame(self, rows: DataFrame) -> None:
        """Appends the rows of a DataFrame, which never pass through the driver. Columns that it lacks take
        their defaults or hook values; a generated key is unique and goes on from the greatest, with gaps."""
        unknown = set(rows.columns) - set(self.meta.columns)
        if unknown:
            raise DefinitionError(f"{self.meta.table} has no {', '.join(sorted(unknown))}")
        with self._store().transaction():
            old, key = self._store().read(self.meta.table), self.meta.key
            new = self._filled(rows)
            if key not in new.columns:
                top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
                new = new.withColumn("_id", F.monotonically_increasing_id()).crossJoin(F.broadcast(top))
                new = new.withColumn(key, (F.col("_top") + 1 + F.col("_id")).cast(self.meta.by_column[key].kind.spark))
            self._store().append(self.meta.table, dml.conformed(new, old))

    def upsert_frame(self, rows: DataFrame, on: Sequence[str] | None = None) -> int:
        """Rows with known keys replace the old ones, the others are added; only files that hold known
        keys are rewritten. Returns how many rows were replaced."""
        return self._upserted(rows, on or self.meta.keys, None)

    def _upserted(self, new: DataFrame, on: Sequence[str], assign: dict[str, Column] | None) -> int:
        keys = new.select(*on).distinct()
        return self._store().rewrite(
            self.meta.table, lambda rows: rows.join(keys, list(on), "left_semi"),
            lambda rows: dml.replaced(rows, new, on, assign), lambda rows: dml.added(rows, new, on, assign),
        )

    def raw_insert(self, record: Any) -> Any:
        return self.raw_insert_all([record])[0]

    def create(self, record: Any) -> Any:
        self._notify("creating", record)
        made = self.session.track(self.meta, self.raw_insert(record))
        self._notify("created", made)
        return made

    def _scoped_key(self, record: Any) -> Query:
        return self._by_key(self.query(), self.meta.key_of(record))

    def _write(self, query: Query, values: dict[str, Any]) -> int:
        hooks = self._hooked("on_update")
        held = set(hooks) | set(self._hooked("on_insert")) | set(self.meta.keys)
        made = {c: v if isinstance(v, Column) else F.lit(v).cast(self.meta.by_column[c].kind.spark) for c, v in values.items() if c not in held}
        return query.update_expr(made | hooks) if made or hooks else 0

    def update(self, record: Any) -> int:
        self._notify("updating", record)
        n = self._write(self._scoped_key(record), self.meta.values(record))
        self._notify("updated", record)
        return n

    def update_partial(self, before: Any, record: Any) -> int:
        """Writes the columns that differ."""
        if self.meta.key_of(before) != self.meta.key_of(record):
            raise DefinitionError("both records must have the same key")
        old = self.meta.values(before)
        changed = {c: v for c, v in self.meta.values(record).items() if v != old.get(c)}
        if not changed:
            return 0
        self._notify("updating", record)
        n = self._write(self._scoped_key(record), changed)
        self._notify("updated", record)
        return n

    def update_all(self, records: Sequence) -> int:
        """One rewrite for all records; returns the rows that matched."""
        if not records:
            return 0
        new = self._frame(records).drop("_at")
        hooks = self._hooked("on_update")
        for column, value in hooks.items():
            new = new.withColumn(column, value)
        keep = (set(self._hooked("on_insert")) | set(self.meta.keys)) - set(hooks)
        with self._store().transaction():
            visible = self.query().df().select(*self.meta.keys)
            new = new.join(visible, self.meta.keys, "left_semi")
            new = self.session.spark.createDataFrame(new.collect(), new.schema)  # the caller's records
            assign = {c: F.col(f"new.{c}") for c in new.columns if c not in keep}
            keys = new.select(*self.meta.keys)
            return self._store().rewrite(self.meta.table, lambda rows: rows.join(keys, self.meta.keys, "left_semi"), lambda rows: dml.replaced(rows, new, self.meta.keys, assign))

    def save(self, record: Any) -> Any:
        before = self.original(record)
        if before is None and None not in self.meta.key_of(record):
            before = self._scoped_key(record).first()
        if before is None:
            return self.create(record)
        self.update_partial(before, record)
        return record

    def upsert(self, record: Any) -> None:
        self.upsert_all([record])

    def upsert_all(self, records: Sequence, on: Sequence[str] | None = None) -> None:
        if records:
            self._upserted(self._frame(records).drop("_at"), on or self.meta.keys, None)

    def insert_on_conflict(self, records: Sequence, on: Sequence[str], assign: dict[str, Column] | None = None, ignore: bool = False) -> int:
        """``ignore``: rows whose ``on`` columns exist are left out; else they take ``assign`` (``new.x``
        and ``old.x``), or all columns of the record. Returns how many were inserted."""
        if not records:
            return 0
        new = self._frame(records).drop("_at")
        with self._store().transaction():
            old = self._store().read(self.meta.table)
            fresh = new.dropDuplicates(list(on)).join(old.select(*on), list(on), "left_anti")
            if self.meta.key not in new.columns:
                fresh = dml.numbered(old, fresh, self.meta.key, [c for c in new.columns])
            made = self.session.spark.createDataFrame(fresh.collect(), fresh.schema)  # the caller's records
            if not ignore:
                values = assign or {c: F.col(f"new.{c}") for c in new.columns if c not in on and c not in self.meta.keys}
                keys = new.select(*on).distinct()
                self._store().rewrite(self.meta.table, lambda rows: rows.join(keys, list(on), "left_semi"), lambda rows: dml.replaced(rows, new, on, values))
            n = made.count()
            if n:
                self._store().append(self.meta.table, dml.conformed(self._filled(made), old))
        return n

    def first_or_create(self, where: Callable[[Any], Column], record: Any) -> Any:
        with self._store().transaction():
            found = self.query().where(where).first()
            return self.create(record) if found is None else found

    def update_or_create(self, where: Callable[[Any], Column], record: Any) -> Any:
        with self._store().transaction():
            found = self.query().where(where).first()
            if found is None:
                return self.create(record)
            self._write(self._scoped_key(found), record.meta.values(record))
            return self.refresh(found)

    def touch(self, record: Any) -> int:
        return self._scoped_key(record).touch()

    def _delete(self, query: Query) -> int:
        for scope in self.scopes:
            rewritten = scope.rewrite_delete(self.meta)
            if rewritten:
                return query.update_expr(rewritten)
        return query.delete()

    def delete(self, record: Any) -> int:
        self._notify("deleting", record)
        n = self._delete(self._scoped_key(record))
        if any(s.rewrite_delete(self.meta) for s in self.scopes):
            self._notify("trashed", record)
        self._notify("deleted", record)
        return n

    def delete_by_id(self, key: Any) -> int:
        return self._delete(self._by_key(self.query(), key))

    def delete_all_by_id(self, keys: Iterable) -> int:
        return self._delete(self._among(self.query(), list(keys)))

    def delete_all(self, records: Iterable) -> int:
        return self.delete_all_by_id([self.meta.key_of(r)[0] for r in records])

    def truncate(self) -> None:
        with self._store().transaction():
            schema = self._store().schema(self.meta.table)
            self._store().write(self.meta.table, self.session.spark.createDataFrame([], schema), schema)

    # soft deletes

    def _deleted_column(self) -> str:
        column = self.meta.marked("deleted_at")
        if not column:
            raise DefinitionError(f"{self.meta.table} has no deleted_at column")
        return column

    def is_trashed(self, record: Any) -> bool:
        return getattr(record, self.meta.by_column[self._deleted_column()].attr) is not None

    def restore(self, record: Any) -> int:
        self._notify("restoring", record)
        n = self.restore_by_id(self.meta.key_of(record))
        self._notify("restored", record)
        return n

    def restore_by_id(self, key: Any) -> int:
        return self._by_key(self.only_trashed(), key).update_expr({self._deleted_column(): F.lit(None)})

    def force_delete(self, record: Any) -> int:
        self._notify("force_deleting", record)
        n = self.force_delete_by_id(self.meta.key_of(record))
        self._notify("force_deleted", record)
        return n

    def force_delete_by_id(self, key: Any) -> int:
        return self._by_key(self.query_without(SoftDeletes.key), key).delete()


class PivotRepo:
    """Links of a many-to-many relationship."""

    def __init__(self, session: Session, rel: Pivot):
        self.session, self.rel = session, rel

    @property
    def _on(self) -> list[str]:
        return [self.rel.source_fk, self.rel.target_fk]

    def _links(self, source: Any, targets: Iterable, extra: dict[str, Any] | None = None) -> DataFrame:
        old = self.session.store.read(self.rel.table)
        kinds = {f.name: f.dataType for f in old.schema}
        rows = [{self.rel.source_fk: source, self.rel.target_fk: t, **(extra or {})} for t in targets]
        names = [*self._on, *(extra or {})]
        return self.session.spark.createDataFrame([tuple(r[c] for c in names) for r in rows], T.StructType([T.StructField(c, kinds[c]) for c in names]))

    def attach(self, source: Any, targets: Iterable, record: Any = None, **extra: Any) -> None:
        """Links with further pivot columns, given by name or as a ``record`` of the pivot's creator."""
        new = self._links(source, targets, self._created(record) | extra)
        with self.session.store.transaction():
            self.session.store.append(self.rel.table, dml.conformed(new, self.session.store.read(self.rel.table)))

    def attach_all(self, source: Any, records: dict[Any, Any]) -> None:
        """A record of the pivot's creator for each target."""
        with self.session.store.transaction():
            for target, record in records.items():
                self.attach(source, [target], record)

    def _created(self, record: Any) -> dict[str, Any]:
        if record is None:
            return {}
        if self.rel.writable is None or not isinstance(record, self.rel.writable):
            raise DefinitionError("the relationship's pivot is not written by such records")
        return {c: v for c, v in record.meta.values(record).items() if c not in self._on}

    def update_pivot(self, source: Any, target: Any, record: Any = None, **extra: Any) -> int:
        """Changes the pivot columns of a link."""
        old = self.session.store.schema(self.rel.table)
        values = {c: F.lit(v).cast(old[c].dataType) for c, v in (self._created(record) | extra).items()}
        hit = (F.col(self.rel.source_fk) == F.lit(source)) & (F.col(self.rel.target_fk) == F.lit(target))
        return self.session.store.rewrite(self.rel.table, lambda rows: rows.where(hit), lambda rows: dml.updated(rows, hit, values))

    def detach(self, source: Any, targets: Iterable | None = None) -> int:
        hit = F.col(self.rel.source_fk) == F.lit(source)
        if targets is not None:
            hit = hit & F.col(self.rel.target_fk).isin(list(targets))
        return self.session.store.rewrite(self.rel.table, lambda rows: rows.where(hit), lambda rows: dml.deleted(rows, hit))

    def detach_all(self, source: Any) -> int:
        return self.detach(source)

    def sync(self, source: Any, targets: Iterable, record: Any = None, **extra: Any) -> SyncResult:
        """Makes ``targets`` the source's links; new ones get the pivot columns."""
        with self.session.store.transaction():
            want = self._links(source, targets)
            have = self.session.store.read(self.rel.table).where(F.col(self.rel.source_fk) == F.lit(source))
            found = SyncResult()
            for row in dml.sync_difference(have, want, [self.rel.target_fk]).orderBy(self.rel.target_fk).collect():
                getattr(found, row["state"]).append(row[self.rel.target_fk])
            if found.detached:
                self.detach(source, found.detached)
            if found.attached:
                self.attach(source, found.attached, record, **extra)
        return found


def _all(tests: list[Column]) -> Column:
    found = tests[0]
    for test in tests[1:]:
        found = found & test
    return found

