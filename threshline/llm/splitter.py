"""Oversized texts cut into overlapping pieces by recursive bisection.

A part longer than ``limit - overlap`` is cut at the strongest boundary near its midpoint and both halves are treated
alike; then every piece after the first gets the last ``overlap`` characters of the text before it.  Boundaries, from
strong to weak: before a hunk header, after a blank line, after a line end.  Only a line that alone exceeds the room of
a piece is cut inside, between a carriage return and its line feed never.

Defined results: null, empty and short texts (up to ``limit``) give no piece; lengths count code points; a repeated row
is split again under its own key.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threshline.llm.batches import slices

LIMIT, OVERLAP = 4000, 200
HUNK = re.compile(r"\n(?=@@ )")
BLANK = re.compile(r"\n[+\- ]?[ \t]*\r?\n")
LINE_END = re.compile(r"\n")


def boundaries(text: str) -> list[list[int]]:
    """Cut positions by strength: hunk headers, blank lines, line ends."""
    hunks = [m.end() for m in HUNK.finditer(text)]
    blanks, at = [], 0
    while m := BLANK.search(text, at):
        blanks.append(m.end())
        at = m.end() - 1
    return [hunks, blanks, [m.end() for m in LINE_END.finditer(text)]]


def cut_near(cuts: list[list[int]], low: int, high: int, room: int, least: int) -> int | None:
    """The strongest boundary in the middle half of (low, high), nearest to the midpoint; else the nearest of any kind.

    One that leaves less than ``least`` characters on a side is taken only where the other side then fits: else what
    remains is a line that must be cut inside anyway, and the short part would be a piece for nothing.
    """
    middle, quarter = (low + high) // 2, (high - low) // 4
    for a, b in ((low + quarter, high - quarter), (low, high)):
        for level in cuts:
            near = []
            k = bisect_left(level, middle)
            for j in (k - 1, k):
                if 0 <= j < len(level) and a < level[j] < b:
                    x = level[j]
                    if min(x - low, high - x) >= least or max(x - low, high - x) <= room:
                        near.append(x)
            if near:
                return min(near, key=lambda x: (abs(x - middle), x))
    return None


def bisect(text: str, room: int, least: int = OVERLAP) -> tuple[list[int], list[int]]:
    """(ends of the parts, positions cut inside a line).  An explicit stack: depth does not follow the text."""
    cuts = boundaries(text)
    ends, forced = [], []
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        if high - low <= room:
            ends.append(high)
            continue
        at = cut_near(cuts, low, high, room, least)
        if at is None:
            at = (low + high) // 2
            if text[at - 1] == "\r" and text[at] == "\n":
                at -= 1
            forced.append(at)
        todo += [(at, high), (low, at)]
    return ends, forced


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], list[int]]:
    """(start, end) of every piece with its overlap, and the 1-based numbers of lines that had to be cut inside."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    ends, forced = bisect(text, limit - overlap, overlap)
    pieces = [(max(0, start - overlap) if start else 0, end) for start, end in zip([0, *ends], ends)]
    feeds = boundaries(text)[2] if forced else []
    return pieces, sorted({bisect_right(feeds, at) + 1 for at in forced})


def split_oversized(df: DataFrame, key: str = "diff_id", text: str = "diff", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start_pos, piece, cut_lines): pieces of each oversized text in order, from 1.

    cut_lines names, in the first piece only, the lines that exceed the room of a piece and had to be cut inside.
    The filter on length runs before Python, so short texts never leave the JVM.
    """
    room = limit - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, start, texts in ((b, *s) for b in batches for s in slices(b.column(1))):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, value in zip(batch.column(0).slice(start, len(texts)).to_pylist(), texts):
                pieces, cut = split_text(value, limit, overlap)
                lines = value.split("\n") if cut else []
                cut = [n for n in cut if len(lines[n - 1]) > room]
                for n, (start, end) in enumerate(pieces, 1):
                    for column, x in zip(rows, (k, n, start + 1, value[start:end], cut if n == 1 else None)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32())))], [key, "piece_no", "start_pos", "piece", "cut_lines"])

    schema = T.StructType([df.schema[key], *(T.StructField(n, t) for n, t in (("piece_no", T.IntegerType()), ("start_pos", T.IntegerType()), ("piece", T.StringType()), ("cut_lines", T.ArrayType(T.IntegerType()))))])
    return df.where(F.length(text) > limit).select(key, text).mapInArrow(run, schema)


def oversized_report(pieces: DataFrame, key: str = "diff_id") -> DataFrame:
    """(key, line_no): 0 for each split text, and each of its lines that no piece can hold."""
    first = pieces.where(F.col("piece_no") == 1)
    return first.select(key, F.explode(F.concat(F.array(F.lit(0)), "cut_lines")).alias("line_no"))
