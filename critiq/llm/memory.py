"""Bounded memory in Python workers, which Spark keeps and hands from task to task."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from itertools import islice

import pyarrow as pa

ENTRY = 100  # bytes of a dictionary's slot beside its key and value


class Cache(dict):
    """A dictionary that makes room, when asked to, once its entries take ``limit`` bytes.

    The half that came in first stays: what is frequent comes early. The other half is forgotten, so that it can
    follow the data.
    """

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.size = limit, 0

    def update(self, pairs: Iterable[tuple]) -> None:
        for key, value in pairs:
            self[key] = value
            self.size += sys.getsizeof(key) + sys.getsizeof(value) + ENTRY

    def make_room(self) -> None:
        if self.size > self.limit:
            first = list(islice(self.items(), len(self) // 2))
            self.clear()
            self.size = 0
            self.update(first)


def _trim() -> None:
    """Hand free memory of Arrow and of the C library back to the machine, where the library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def released(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """rows, which hands its memory back when a task's batches are through: the worker stays for later stages."""

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            _trim()

    return run
