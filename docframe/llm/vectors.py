"""Helpers for vector columns: which vectors take part, and cosines that do not depend on a row's place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """False for null, empty and zero vectors and for those with null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def units(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as unit vectors in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    x = np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, width or 1))
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.Table]:
    """Cuts rows that come sorted by ``keys`` into one table for each key, or several of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            last = key
            while a < b:
                take = b - a if most is None else min(b - a, most - size)
                held.append(batch.slice(a, take))
                a, size = a + take, size + take
                if most is not None and size == most:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
