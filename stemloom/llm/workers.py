"""Memory of Python workers, which outlive their tasks beside the executor's heap."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

#: Rows of a batch that are handled at once.
ROWS = 1024


def trim() -> None:
    """Give memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``each`` for ``mapInArrow``, fed at most ``rows`` rows of a batch at once; what it held is given back after the task."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), rows):
                yield whole.slice(at, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from each(sliced(batches))
        finally:
            trim()

    return run
