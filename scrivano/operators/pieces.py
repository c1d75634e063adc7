"""Arrow batches in pieces, so that a task's Python holds so many bytes of text, whatever a batch has."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text in a piece; a row that has more is one of its own.
PIECE = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in their order, so many at a time that their strings have at most ``size`` bytes, one row at least."""
    for batch in batches:
        wide = np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                wide += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(wide)
        at = 0
        while at < batch.num_rows:
            stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")), at + 1)
            yield batch.slice(at, stop - at)
            at = stop
