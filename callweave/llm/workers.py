"""What a Python worker holds: small batches, one large thing at a time, and memory given back after each task.

Spark keeps workers from step to step. Without this, a step pays for tables and freed memory of the steps before it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_SIZE = "8m"
_HELD: dict[Any, Any] = {}


def held(key: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, made once in a worker and kept until another large thing, or a step that holds none, takes its place."""
    if key not in _HELD:
        dropped()
        _HELD[key] = make()
    return _HELD[key]


def dropped() -> None:
    if _HELD:
        _HELD.clear()
        given_back()


@cache
def _trim() -> Callable[[int], int]:
    """The C library's malloc_trim, or nothing where it has none."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def given_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def tidied(work: Callable[[Iterator], Iterator], batches: Iterator, holds: bool) -> Iterator:
    if not holds:
        dropped()
    yield from work(batches)
    given_back()


def mapped(rows: DataFrame, work: Callable[[Iterator], Iterator], schema: str, holds: bool = False) -> DataFrame:
    """rows.mapInArrow(work, schema) in batches of 8 MB, unless the session names a size; holds: work calls held()."""
    spark = rows.sparkSession
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, BATCH_SIZE)
    return rows.mapInArrow(lambda bs: tidied(work, bs, holds), schema)
