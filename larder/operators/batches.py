"""Arrow batches in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterable[pa.RecordBatch], column: str | int = "text", most: int = 2 << 20, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``most`` bytes together (one row at least), for bounded memory."""
    for batch in batches:
        total = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(total, base + most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
