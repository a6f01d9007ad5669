"""What backends can do. The engine itself runs on Spark; a database behind a session can be asked for
more in its own SQL, and what a backend lacks is told before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

from ..model import CapabilityError


@dataclass(frozen=True)
class Dialect:
    name: str
    #: Quotes around identifiers.
    quote: str
    features: frozenset[str]

    def require(self, feature: str) -> None:
        if feature not in self.features:
            raise CapabilityError(f"{self.name} has no {feature.replace('_', ' ')}")

    def identifier(self, name: str) -> str:
        return f"{self.quote}{name.replace(self.quote, self.quote * 2)}{self.quote}"

    def window(self, limit: int | None, offset: int | None) -> str:
        """The clause for a slice of the rows."""
        if limit is None and not offset:
            return ""
        if "fetch_first" in self.features:
            skip = f" OFFSET {offset or 0} ROWS"
            return skip + ("" if limit is None else f" FETCH NEXT {limit} ROWS ONLY")
        # some have no OFFSET without LIMIT
        most = "" if limit is None and "offset_alone" in self.features else f" LIMIT {(1 << 63) - 1 if limit is None else limit}"
        return most + (f" OFFSET {offset}" if offset else "")


def _dialect(name: str, quote: str, features: str) -> Dialect:
    return Dialect(name, quote, frozenset(features.split()))


# Features of SQL dialects by the subprotocol of their JDBC urls.
DIALECTS = {
    "spark": _dialect("Spark", "`", "ilike arrays offset_alone returning on_conflict batch_update"),
    "postgresql": _dialect("PostgreSQL", '"', "ilike arrays offset_alone returning on_conflict row_locks share_locks skip_locked batch_update"),
    "mysql": _dialect("MySQL", "`", "row_locks share_locks skip_locked batch_update"),
    "sqlite": _dialect("SQLite", '"', "returning on_conflict batch_update"),
    "h2": _dialect("H2", '"', "ilike arrays offset_alone row_locks batch_update"),
    "oracle": _dialect("Oracle", '"', "fetch_first row_locks skip_locked batch_update"),
    "clickhouse": _dialect("ClickHouse", "`", "ilike arrays offset_alone"),
    "derby": _dialect("Derby", '"', "fetch_first batch_update"),
}


def dialect_of(url: str) -> Dialect:
    """The dialect of a JDBC url."""
    kind = url.removeprefix("jdbc:").split(":", 1)[0].lower()
    if kind not in DIALECTS:
        raise CapabilityError(f"no dialect for {kind}")
    return DIALECTS[kind]
