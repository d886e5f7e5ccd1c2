"""Arrow batches in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Characters held as Python strings at once; bounds memory and changes no result.
SLICE_CHARS = 3_000_000


def slices(column: pa.Array, most: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(start, texts) in groups of about ``most`` characters, so that memory does not follow the batch."""
    start, chars, group = 0, 0, []
    for value in column.to_pylist():
        group.append(value)
        chars += len(value or "")
        if chars >= most:
            yield start, group
            start, chars, group = start + len(group), 0, []
    if group:
        yield start, group


