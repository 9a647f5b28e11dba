"""Arrow string columns as byte arrays, a bounded piece at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is handled alone.
BATCH_BYTES = 8_000_000


def slices(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows i to j of about ``most`` bytes: i, j, their bytes in a row, and where each text begins there (with the end).
    Nulls are empty texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pieces(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The strings between ascending places of ``raw``."""
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
