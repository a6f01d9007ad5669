"""Records one after another, without holding the whole result on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame


def records(rows: DataFrame, make: Callable[[Any], Any]) -> Iterator[Any]:
    """Fetches a partition ahead while the caller works on the current one."""
    for row in rows.toLocalIterator(prefetchPartitions=True):
        yield make(row)


def chunks(found: Iterator[Any], size: int) -> Iterator[list]:
    if size < 1:
        raise ValueError("chunks need a positive size")

    def batches() -> Iterator[list]:
        held: list = []
        for record in found:
            held.append(record)
            if len(held) == size:
                yield held
                held = []
        if held:
            yield held

    return batches()
