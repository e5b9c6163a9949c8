"""Texts as numpy code points, in chunks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Characters that a stage holds as arrays at once; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 19


def points(text: str) -> np.ndarray:
    """The code points of ``text`` as uint32; lone surrogates are kept."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def chunks(batch: pa.RecordBatch, column: int, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of ``batch`` in runs of about ``most`` characters."""
    values = batch.column(column)
    start, held, total = 0, [], 0
    for row in range(batch.num_rows):
        text = values[row].as_py()
        held.append(text)
        total += len(text or "")
        if total >= most:
            yield start, held
            start, held, total = row + 1, [], 0
    if held:
        yield start, held
