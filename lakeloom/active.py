"""Records that know their repository."""

from __future__ import annotations

from typing import Any

from .operators.query import lazy_load
from .repo import Repo


class Active:
    """A record together with its repository: ``Active(repo, record).save()``."""

    def __init__(self, repo: Repo, record: Any):
        self.repo, self.record = repo, record

    def save(self) -> Active:
        self.record = self.repo.save(self.record)
        return self

    def create(self) -> Active:
        self.record = self.repo.create(self.record)
        return self

    def delete(self) -> int:
        return self.repo.delete(self.record)

    def force_delete(self) -> int:
        return self.repo.force_delete(self.record)

    def restore(self) -> int:
        return self.repo.restore(self.record)

    def refresh(self) -> Active:
        self.record = self.repo.refresh(self.record)
        return self

    def touch(self) -> int:
        return self.repo.touch(self.record)

    @property
    def trashed(self) -> bool:
        return self.repo.is_trashed(self.record)

    def same_as(self, other: Any) -> bool:
        """Equal table and key, whatever the other columns hold."""
        other = other.record if isinstance(other, Active) else other
        meta = self.record.meta
        return other is not None and meta.table == other.meta.table and meta.key_of(self.record) == other.meta.key_of(other)

    @property
    def is_dirty(self) -> bool:
        """False for records that were never loaded."""
        return self.repo.is_dirty(self.record)

    @property
    def is_clean(self) -> bool:
        return not self.is_dirty

    @property
    def original(self) -> Any:
        return self.repo.original(self.record)

    @property
    def changes(self) -> dict[str, Any]:
        return self.repo.changes(self.record)

    def load(self, rel: Any, scoped: bool = False) -> list:
        return lazy_load(self.repo.session, self.record, rel, scoped)

    def load_one(self, rel: Any, scoped: bool = False) -> Any:
        return next(iter(self.load(rel, scoped)), None)
