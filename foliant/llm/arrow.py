"""Helpers of functions that run over Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory to the system, so that what one stage needed does not stand beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def sized(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of ``column``; a row over the limit is a batch of its own. Workers outlive tasks,
    so the memory of earlier tasks that Arrow and the C library keep for reuse is given back first."""
    give_back()
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(sizes, dtype=np.int64), 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null becomes the empty string."""
    return [text or "" for text in batch.column(column).to_pylist()]


def lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the end of each list."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def per_process(name: str, make: Callable):
    """One object per Python worker, made at its first use. Workers outlive tasks, so loaded vocabularies and word tables
    serve all of a worker's tasks; functions travel by value, so a global of this package would not."""
    home = sys.modules.setdefault("_foliant_worker", types.ModuleType("_foliant_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)
