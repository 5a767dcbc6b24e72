"""Arrow string columns as numpy code-point arrays, and back.

All text operators of this subpackage see a batch as one flat ``uint32`` array of code points with row offsets, so that
their work is a handful of whole-batch numpy passes and never a Python call for each row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of a batch are taken in runs of about so many characters, which bounds the memory of a task whatever the texts' lengths.
RUN_CHARS = 2_000_000


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a string column; a null row is as long as an empty one."""
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    try:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:  # damaged bytes, which Spark's strings may hold: take row by row, with U+FFFD for them
        whole = raw.tobytes()
        rows = [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1] - at[0], at[1:] - at[0])]
        return code_points(pa.array(rows, pa.large_string()))
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=before[1:])
    return points, before[at - at[0]]


def strings(points: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string column of code points and row offsets; rows that aren't valid become null."""
    data = points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = np.zeros(len(points) + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=width[1:])
    nulls = None if valid is None else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(width[offsets].astype(np.int32).tobytes()), pa.py_buffer(data), nulls)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def keep(points: np.ndarray, offsets: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points under a mask, with their new offsets."""
    before = np.zeros(len(points) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return points[mask], before[offsets]


def runs(batches: Iterator[pa.RecordBatch], column: str, chars: int = RUN_CHARS) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about so many bytes of a string column; a longer row is a run of its own."""
    for batch in batches:
        size = batch.column(column).cast(pa.large_string())
        n = len(size)
        if n == 0:
            continue
        at = np.frombuffer(size.buffers()[1], np.int64, n + 1, size.offset * 8)
        start = 0
        while start < n:
            end = max(start + 1, int(np.searchsorted(at, at[start] + chars, "right")) - 1)
            yield batch.slice(start, min(end, n) - start)
            start = min(end, n)
