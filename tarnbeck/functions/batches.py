"""Cutting Arrow batches so that a batch of long texts takes no more memory than one of short ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once in a Python worker; a single longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def slices(batches: Iterator[pa.RecordBatch], column: int = -1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut wherever the text of ``column`` would exceed ``limit`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column % batch.num_columns)
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            done = size[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch if hi - lo == batch.num_rows else batch.slice(lo, hi - lo)
            lo = hi
