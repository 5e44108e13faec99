"""Array helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of many spans, one after the other."""
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def portions_of(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes in ``column`` (one row at least)."""
    size = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
    for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(int(a), int(b - a))
