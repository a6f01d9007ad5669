"""Parameterized SQL: values are bound, identifiers are checked, fragments nest."""

from __future__ import annotations

import datetime as dt
import decimal
import re
import textwrap
from dataclasses import dataclass, field
from typing import Any

from .model import DefinitionError, EntityMeta

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_MARK = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|::|:([A-Za-z_][A-Za-z0-9_]*)")


@dataclass(frozen=True)
class SqlLiteral:
    """SQL text that is spliced, not bound."""

    text: str


def identifier(name: str) -> SqlLiteral:
    if not _NAME.fullmatch(name):
        raise DefinitionError(f"{name!r} is no identifier")
    return SqlLiteral(f"`{name}`")


@dataclass(frozen=True)
class Fragment:
    """SQL text with named values. ``:name`` marks a value, another fragment or a literal."""

    text: str
    values: dict[str, Any] = field(default_factory=dict)

    def rendered(self, prefix: str = "p") -> tuple[str, dict[str, Any]]:
        """Text and arguments for ``spark.sql``; nested fragments get names of their own."""
        args: dict[str, Any] = {}

        def put(m: re.Match) -> str:
            name = m[1]
            if name is None:
                return m[0]
            if name not in self.values:
                raise DefinitionError(f"no value for :{name}")
            value = self.values[name]
            if isinstance(value, SqlLiteral):
                return value.text
            if isinstance(value, Fragment):
                text, own = value.rendered(f"{prefix}_{name}")
                args.update(own)
                return text
            args[f"{prefix}_{name}"] = value
            return f":{prefix}_{name}"

        return _MARK.sub(put, self.text), args

    def strip_margin(self, mark: str = "|") -> "Fragment":
        lines = [re.sub(rf"^\s*{re.escape(mark)}", "", x) for x in self.text.split("\n")]
        return Fragment(textwrap.dedent("\n".join(lines)), self.values)


def sql(text: str, **values: Any) -> Fragment:
    return Fragment(text, values)


def literal(value: Any) -> str:
    """A value as a SQL literal, for expressions that take no arguments."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, float):
        return f"CAST('{value!r}' AS DOUBLE)"
    if isinstance(value, int):
        return str(value) if abs(value) < 1 << 31 else f"CAST('{value}' AS BIGINT)"
    if isinstance(value, decimal.Decimal):
        return f"{value}BD"
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP{'_NTZ' if value.tzinfo is None else ''} '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(map(literal, value))})"
    raise DefinitionError(f"no literal for {type(value).__name__}")


def bound(text: str, values: dict[str, Any]) -> str:
    """``text`` with each ``:name`` replaced by its literal."""
    text, args = Fragment(text, values).rendered("v")
    return _MARK.sub(lambda m: m[0] if m[1] is None else literal(args[m[1]]), text)


class TableInfo:
    """Safe names of an entity's table and columns for raw SQL."""

    def __init__(self, meta: EntityMeta, alias: str | None = None):
        self._meta, self._alias = meta, alias

    def alias(self, name: str) -> "TableInfo":
        identifier(name)
        return TableInfo(self._meta, name)

    @property
    def table(self) -> SqlLiteral:
        return SqlLiteral(f"`{self._meta.table}`" + (f" AS `{self._alias}`" if self._alias else ""))

    @property
    def all(self) -> SqlLiteral:
        return SqlLiteral(", ".join(self[c].text for c in self._meta.columns))

    @property
    def insert_columns(self) -> SqlLiteral:
        return SqlLiteral("(" + ", ".join(f"`{f.column}`" for f in self._meta.fields if not (f.pk or f.marker)) + ")")

    def __getitem__(self, name: str) -> SqlLiteral:
        column = self._meta.column(name)
        return SqlLiteral(f"`{self._alias}`.`{column}`" if self._alias else f"`{column}`")

    def __getattr__(self, name: str) -> SqlLiteral:
        if name.startswith("__"):
            raise AttributeError(name)
        return self[name]
