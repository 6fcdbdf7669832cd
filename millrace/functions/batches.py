"""Arrow batches in Python functions, a piece at a time.

Spark sends up to 10,000 rows or 64 MB at once. As Python values, with what is made of them, they would take several times
that in each of an executor's workers, so only a piece of them is turned into Python values, and goes back, at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

#: Bytes of a batch that are Python values at once.
PIECE = 1 << 20

#: glibc's release of free heap; null elsewhere.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def pieces(rows, limit: int = PIECE):
    """An Arrow array or batch cut, without a copy, into runs of at most ``limit`` bytes, or one row; an empty one stays."""
    todo = [rows]
    while todo:
        part = todo.pop()
        if len(part) > 1 and part.nbytes > limit:
            half = len(part) // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def by_piece(batches: Iterable, kind: pa.DataType, made: Callable, limit: int = PIECE) -> Iterator[pa.Array]:
    """``made`` of each row's values, row by row, as arrays of ``kind``. Batches are arrays, or tuples of arrays if there
    are several arguments. What a batch took goes back to the system: workers serve stage after stage."""
    for batch in batches:
        many = isinstance(batch, tuple)
        for part in pieces(pa.RecordBatch.from_arrays(list(batch), [f"c{i}" for i in range(len(batch))]) if many else batch, limit):
            rows = zip(*(c.to_pylist() for c in part.columns)) if many else ((v,) for v in part.to_pylist())
            yield pa.array([made(*row) for row in rows], kind)
        del batch, part, rows
        pa.default_memory_pool().release_unused()
        if _TRIM is not None:
            _TRIM(0)
