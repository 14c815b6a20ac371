"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` texts and about ``size`` bytes, which bounds the memory of a task. A text stays whole."""
    for whole in batches:
        step = max(1, min(rows, whole.num_rows * size // max(1, whole.nbytes)))
        for at in range(0, whole.num_rows, step):
            yield whole.slice(at, step)
