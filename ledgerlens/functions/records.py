"""Records of delimited texts: a plain helper that runs inside Arrow tasks, one bounded file at a time."""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle

# Ship these helpers inside the task, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RECORDS = "name string, delimiter string, row_no int, cells array<string>"
BATCH_ROWS, BATCH_CHARS = 4096, 8_000_000  # of one batch handed on
LARGEST_CELL = 2**31 - 1


def header_names(cells: list[str | None]) -> list[str]:
    """Names of the header's cells: those without a text by their place, repeated ones numbered."""
    names: list[str] = []
    for i, cell in enumerate(cells):
        name, n = cell or f"Unnamed: {i}", 0
        while (f"{name}.{n}" if n else name) in names:
            n += 1
        names.append(f"{name}.{n}" if n else name)
    return names


def records(text: str, mark: str) -> Iterator[list[str]]:
    """The header, then the records that fit it; quoted cells may hold marks and line breaks."""
    csv.field_size_limit(LARGEST_CELL)
    rows = (r for r in csv.reader(io.StringIO(text, newline=""), delimiter=mark) if r and not (len(r) == 1 and r[0].isspace()))
    width = len(head := header_names(next(rows, [])))
    yield head
    for row in rows:
        if len(row) == width + 1 and row[-1] == "":
            row.pop()
        if len(row) <= width:
            yield row + [""] * (width - len(row))


def file_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, delimiter, text) to one row per record; row 0 of each file is its header."""
    names, marks, places, cells, chars = [], [], [], [], 0

    def handed_on() -> pa.RecordBatch:
        arrays = [pa.array(names, pa.string()), pa.array(marks, pa.string()), pa.array(places, pa.int32()), pa.array(cells, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, ["name", "delimiter", "row_no", "cells"])

    for batch in batches:
        for name, mark, text in zip(*(batch.column(c) for c in ("name", "delimiter", "text"))):
            for n, row in enumerate(records(text.as_py(), mark.as_py())):
                names.append(name.as_py())
                marks.append(mark.as_py())
                places.append(n)
                cells.append(row)
                chars += sum(map(len, row))
                if len(names) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield handed_on()
                    names, marks, places, cells, chars = [], [], [], [], 0
    if names:
        yield handed_on()
