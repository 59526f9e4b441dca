"""Strings of Arrow batches as byte arrays, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text looked at in one go.
SLICE_BYTES = 1 << 20


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(col.buffers()[2], np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of utf8, for less than 2 GB."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def rows_of(col: pa.Array, length: int) -> np.ndarray:
    """One row of bytes for each string of a column of strings of one length."""
    return utf8(col)[0].reshape(-1, length)


def from_rows(rows: np.ndarray) -> pa.Array:
    """Each row of bytes as a string."""
    return strings(rows.reshape(-1), np.arange(len(rows) + 1) * rows.shape[1])


def cuts(offsets: np.ndarray, most: int = SLICE_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows that hold ``most`` bytes or a single row."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def table(old: str, new: str) -> np.ndarray:
    """A byte each: what it is translated to, itself if not in ``old``."""
    out = np.arange(256, dtype=np.uint8)
    out[list(old.encode())] = list(new.encode())
    return out


COMPLEMENT, CHANGED = table("ACGTN", "TGCAN"), table("ACGTN", "CGTAN")
