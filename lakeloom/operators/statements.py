"""INSERT, UPDATE and DELETE as text, over the store.

A statement is split into its clauses; conditions and expressions are Spark's own SQL. The number of
changed rows comes back, and with RETURNING the named expressions of those rows: the new ones of an
INSERT or UPDATE, the old ones of a DELETE. Tables in subqueries are found as views (``Session.views``).
"""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CapabilityError, DefinitionError
from ..rawsql import Fragment, bound
from . import dml

if TYPE_CHECKING:
    from ..sources.session import Changed, Session

_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|`[^`]*`|--[^\n]*|[A-Za-z_][A-Za-z0-9_]*|\s+|.", re.S)
_TABLE = re.compile(r"\s*`?([A-Za-z_][A-Za-z0-9_.]*)`?(?:\s+(?:AS\s+)?`?([A-Za-z_][A-Za-z0-9_]*)`?)?\s*", re.I)
_INTO = re.compile(r"\s*`?([A-Za-z_][A-Za-z0-9_.]*)`?\s*(?:\(([^)]*)\))?\s*\b((?:SELECT|VALUES|WITH)\b.*)", re.I | re.S)


def clauses(text: str, *words: str) -> dict[str, str]:
    """The text after each of ``words`` that stands outside brackets and quotes; "" is what goes before."""
    found: dict[str, list[str]] = {"": []}
    at, depth = "", 0
    for token in _TOKEN.findall(text.strip().rstrip(";")):
        depth += (token == "(") - (token == ")")
        word = token.upper()
        if not depth and word in words and word not in found:
            at = word
            found[at] = []
        elif not token.startswith("--"):
            found[at].append(token)
    return {k: "".join(v).strip() for k, v in found.items()}


def listed(text: str) -> list[str]:
    """Parts between commas that stand outside brackets and quotes."""
    out, depth = [""], 0
    for token in _TOKEN.findall(text):
        depth += (token in "([") - (token in ")]") if len(token) == 1 else 0
        if token == "," and not depth:
            out.append("")
        else:
            out[-1] += token
    return [x.strip() for x in out if x.strip()]


def _target(text: str, form: re.Pattern) -> re.Match:
    m = form.fullmatch(text)
    if not m:
        raise DefinitionError(f"{text!r} names no table, or nothing for it")
    return m


def _returned(rows: DataFrame, names: str | None) -> list | None:
    return None if names is None else rows.select(*[F.expr(n) for n in listed(names)]).collect()


def execute(session: Session, fragment: Fragment) -> Changed:
    if session.store is None:
        raise CapabilityError("changes need a session with a store")
    text = bound(fragment.text, fragment.values)
    kind = text.strip().split(None, 1)[0].upper() if text.strip() else ""
    run = {"DELETE": _delete, "UPDATE": _update, "INSERT": _insert}.get(kind)
    if run is None:
        raise DefinitionError(f"{kind or 'an empty text'} is no statement that changes rows")
    with session.store.transaction():
        return run(session, text)


def _condition(parts: dict[str, str]) -> Column:
    return F.expr(parts["WHERE"]) if "WHERE" in parts else F.lit(True)


def _delete(session: Session, text: str) -> Changed:
    from ..sources.session import Changed

    parts = clauses(text, "FROM", "WHERE", "RETURNING")
    m = _target(parts.get("FROM", ""), _TABLE)
    table, alias = m[1], m[2] or m[1]
    test = _condition(parts)
    rows = session.store.read(table).alias(alias).where(test)
    found = _returned(rows, parts.get("RETURNING"))
    n = session.store.rewrite(table, lambda r: r.alias(alias).where(test), lambda r: dml.deleted(r.alias(alias), test))
    return Changed(n, found)


def _update(session: Session, text: str) -> Changed:
    from ..sources.session import Changed

    parts = clauses(text, "UPDATE", "SET", "WHERE", "RETURNING")
    m = _target(parts.get("UPDATE", ""), _TABLE)
    table, alias = m[1], m[2] or m[1]
    names = {n.lower(): n for n in session.store.read(table).columns}
    values = {}
    for part in listed(parts.get("SET", "")):
        name, sign, value = part.partition("=")
        name = name.strip().strip("`").split(".")[-1].lower()
        if not sign or name not in names:
            raise DefinitionError(f"{part!r} sets no column of {table}")
        values[names[name]] = F.expr(value)
    if not values:
        raise DefinitionError("UPDATE sets no column")
    test = _condition(parts)
    rows = session.store.read(table).alias(alias).where(test)
    found = _returned(dml.updated(rows, F.lit(True), values).alias(alias), parts.get("RETURNING"))
    n = session.store.rewrite(table, lambda r: r.alias(alias).where(test), lambda r: dml.updated(r.alias(alias), test, values))
    return Changed(n, found)


def _insert(session: Session, text: str) -> Changed:
    from ..sources.session import Changed

    parts = clauses(text, "INTO", "RETURNING")
    m = _target(parts.get("INTO", ""), _INTO)
    table = m[1]
    old = session.store.read(table)
    names = [n.strip().strip("`") for n in m[2].split(",")] if m[2] else old.columns
    new = session.spark.sql(m[3])
    if len(new.columns) != len(names) or set(names) - set(old.columns):
        raise DefinitionError(f"the columns of the INSERT are not those of {table}")
    new = new.toDF(*names)
    for f in session.store.schema(table):
        default = (f.metadata or {}).get("default")
        if default is not None and f.name not in names:
            new = new.withColumn(f.name, F.expr(default).cast(f.dataType))
    before = set(old.inputFiles())
    session.store.append(table, dml.conformed(new, old))
    # the rows as they were written: a SELECT may give others when it runs again
    written = session.store.added(table, before)
    return Changed(written.count(), _returned(written, parts.get("RETURNING")))
