"""Arrow batches in pieces of bounded bytes: a batch has up to 10,000 rows, however long these are, so what a task makes of a batch is made of a piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a piece; one longer row is a piece of its own.
PIECE_BYTES = 1 << 20


def _ends(column: pa.Array) -> np.ndarray:
    """Bytes of the rows up to and with each one, of strings or of arrays of strings."""
    if pa.types.is_list(column.type):
        inner = np.append(0, _ends(column.flatten()))
        return inner[np.cumsum(column.value_lengths().fill_null(0).to_numpy())]
    return np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(), dtype=np.int64)


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, in order, by the bytes of a column."""
    ends, first = _ends(batch.column(column)), 0
    while first < batch.num_rows:
        before = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(first, end - first)
        first = end
