"""What a task leaves behind in its Python worker: nothing.

Workers live on from task to task and from stage to stage. What a finished task keeps, in caches of modules or in freed but
unreturned memory, is added to all that later stages need."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

FORGOTTEN: list[dict] = []


def forgotten(cache: dict) -> dict:
    """A module's cache that is emptied at the end of every task."""
    FORGOTTEN.append(cache)
    return cache


def released() -> None:
    """Empty the caches and return freed memory to the system, as far as its C library can."""
    for cache in FORGOTTEN:
        cache.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, leaving nothing behind."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            released()

    return wrapped
