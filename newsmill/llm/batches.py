"""Small helpers for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the column's values hold about ``most`` bytes, a row at least."""
    for batch in batches:
        start, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            size += n or 0
            if size >= most:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts end to end as bytes, and where each begins and the last one ends; null is empty."""
    raw = [t.as_buffer() if t.is_valid else b"" for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    return np.frombuffer(b"".join(raw), np.uint8), ends


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list array from flat values; ``ends`` are the lists' borders, from zero."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
