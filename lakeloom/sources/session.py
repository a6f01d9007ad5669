"""Sessions: where tables come from, where statements are logged, what was loaded."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..model import EngineError, EntityMeta
from ..rawsql import Fragment, bound
from .dialects import DIALECTS, Dialect, dialect_of
from .store import Store


@dataclass(frozen=True)
class Changed:
    """What a statement changed: the number of rows, and those that RETURNING asked for."""

    count: int
    rows: list | None = None


class QueryFailed(EngineError):
    pass


class SqlLogger:
    """``slow_after`` seconds (None: everything is logged); nothing is logged by default."""

    def __init__(self, emit: Callable[[str], None] | None = None, slow_after: float | None = None):
        self.emit, self.slow_after = emit, slow_after

    @classmethod
    def default(cls) -> "SqlLogger":
        return cls(logging.getLogger("lakeloom").info)

    @contextmanager
    def timed(self, what: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        except EngineError:
            raise
        except Exception as failure:
            if self.emit:
                self.emit(f"failed: {what}: {failure}")
            raise QueryFailed(f"{what}: {failure}") from failure
        took = time.perf_counter() - began
        if self.emit and (self.slow_after is None or took >= self.slow_after):
            self.emit(f"{what} took {took:.3f} s")


@dataclass(frozen=True)
class JdbcParts:
    """How a table of a database is read by several tasks."""

    column: str
    lower: int | str
    upper: int | str
    tasks: int


class Session:
    """Tables are looked up in ``tables``, then in the store, then in Spark's catalog."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame] | Callable[[str], DataFrame] | None = None, store: Store | None = None, logger: SqlLogger | None = None):
        self.spark, self.store, self.logger = spark, store, logger or SqlLogger()
        self._tables = tables or {}
        self.scopes: dict[str, tuple] = {}
        self.loaded: dict[tuple, Any] = {}
        self.database: tuple[str, dict[str, str]] | None = None

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, **options: Any) -> "Session":
        return cls(spark, lambda name: spark.read.parquet(f"{folder}/{name}.parquet"), **options)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: dict[str, str], parts: Mapping[str, JdbcParts] | None = None, fetch_size: int = 10_000, **options: Any) -> "Session":
        """Tables of a database. ``parts`` says by which column and bounds a table is read by several
        tasks; rows outside the bounds go to the first and last of them. Filters and columns go into the
        database's statement."""
        settings = properties | {"fetchsize": str(fetch_size)}

        def frame(name: str) -> DataFrame:
            cut = (parts or {}).get(name)
            if cut is None:
                return spark.read.jdbc(url, name, properties=settings)
            return spark.read.jdbc(url, name, column=cut.column, lowerBound=cut.lower, upperBound=cut.upper, numPartitions=cut.tasks, properties=settings)

        found = cls(spark, frame, **options)
        found.database = url, settings
        return found

    @property
    def dialect(self) -> Dialect:
        return dialect_of(self.database[0]) if self.database else DIALECTS["spark"]

    def native(self, fragment: Fragment | str, limit: int | None = None, offset: int | None = None, **values: Any) -> DataFrame:
        """A SELECT in the database's own SQL, run there; what is not in it runs on Spark."""
        if self.database is None:
            raise EngineError("native SQL needs a session over a database")
        fragment = fragment if isinstance(fragment, Fragment) else Fragment(fragment, values)
        url, properties = self.database
        text = bound(fragment.text, fragment.values) + self.dialect.window(limit, offset)
        return self.spark.read.format("jdbc").options(url=url, query=text, **properties).load()

    def save(self, table: str, rows: DataFrame, mode: str = "append", batch_size: int = 10_000, connections: int | None = None) -> None:
        """Writes rows to a table of the database, by at most ``connections`` tasks at a time; each task
        commits its own part."""
        if self.database is None:
            raise EngineError("saving needs a session over a database")
        url, properties = self.database
        if connections is not None:
            rows = rows.coalesce(connections)
        rows.write.option("batchsize", batch_size).jdbc(url, table, mode, properties)

    def register(self, entity: Any, *scopes: Any) -> None:
        """Scopes that apply wherever the entity is read by a scoped query."""
        self.scopes[entity.meta.table] = scopes

    def scopes_of(self, meta: EntityMeta) -> tuple:
        return self.scopes.get(meta.table, ())

    def frame(self, table: str) -> DataFrame:
        if callable(self._tables):
            return self._tables(table)
        if table in self._tables:
            return self._tables[table]
        if self.store and self.store.exists(table):
            return self.store.read(table)
        return self.spark.table(table)

    def table(self, meta: EntityMeta) -> DataFrame:
        """Only the entity's columns, so scans read no others."""
        return self.frame(meta.table).select(*meta.columns)

    def sql(self, fragment: Fragment | str, **values: Any) -> DataFrame:
        fragment = fragment if isinstance(fragment, Fragment) else Fragment(fragment, values)
        text, args = fragment.rendered()
        with self.logger.timed(text):
            return self.spark.sql(text, args=args)

    def execute(self, fragment: Fragment | str, **values: Any) -> Changed:
        """Runs an INSERT, UPDATE or DELETE over the store; see ``statements``."""
        from ..operators.statements import execute

        fragment = fragment if isinstance(fragment, Fragment) else Fragment(fragment, values)
        with self.logger.timed(fragment.text):
            return execute(self, fragment)

    def views(self, *tables: str) -> None:
        """Makes tables known to SQL by their names."""
        for name in tables:
            self.frame(name).createOrReplaceTempView(name)

    def track(self, meta: EntityMeta, record: Any) -> Any:
        """The first loaded record of a key stands."""
        self.loaded.setdefault((meta.table, meta.key_of(record)), record.copy())
        return record

    def original(self, record: Any) -> Any:
        return self.loaded.get((record.meta.table, record.meta.key_of(record)))

    @contextmanager
    def transact(self) -> Iterator["Session"]:
        """All changes of the block are published together, or none of them."""
        if self.store is None:
            raise EngineError("a transaction needs a store")
        with self.store.transaction():
            yield self
