"""Statement files: what they are, and delimited text as a grid of cells.

Files are rows (file_id, content) as `binaryFile` gives them; one file is read by one task, many files by many.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: First bytes of a zip and of an OLE2 file; delimiters tried in this order; lines and characters that a sniff reads.
ZIP, OLE2 = "504B0304", "D0CF11E0A1B11AE1"
DELIMITERS = (",", ";", "\t", "|")
SNIFF_LINES, SNIFF_CHARS, LEAST_FIELDS = 40, 4_000, 3
#: Cells from which on a batch of them leaves the parser.
BATCH_CELLS = 10_000

_BREAK = re.compile(r"\r\n|\r|\n")
_NUMBER = re.compile(r"[-+(]?[\d,. ]+\)?")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file_id"), "content")


def _unquoted(field: str) -> str:
    """A field without its quotes; one between two quoted parts that touch is part of the text."""
    if '"' not in field:
        return field
    parts = field.split('"')
    return "".join('"' if not x and not k & 1 and 0 < k < len(parts) - 1 else x for k, x in enumerate(parts))


def _fields(text: str, delimiter: str) -> Iterator[list[str]]:
    """Rows of fields by the usual quoting rules: quotes hold delimiters, line ends and doubled quotes."""
    d = re.escape(delimiter)
    row = []
    for m in re.finditer(rf'((?:[^"{d}\r\n]++|"[^"]*+(?:"|\Z))*+)({d}|\r\n|\r|\n|\Z)', text):
        field, end = m.groups()
        if not end:
            last = _unquoted(field)
            if row or last:
                yield [*row, last]
            break
        row.append(_unquoted(field))
        if end != delimiter:
            yield row
            row = []


def _bare(line: str) -> str:
    """A line without what quotes hold."""
    return "".join(line.split('"')[::2]) if '"' in line else line


def sniff_delimiter(text: str) -> str:
    """The delimiter that splits the most lines alike, into the most fields; a comma if none does."""
    lines = [_bare(x) for x in itertools.islice((x for x in _lines(text) if x.strip()), SNIFF_LINES)]
    best, best_score = ",", 0
    for d in DELIMITERS:
        widths = Counter(n for x in lines if (n := x.count(d) + 1) >= 2)
        agree, width = max(((n, w) for w, n in widths.items()), default=(0, 0))
        if agree * width > best_score:
            best, best_score = d, agree * width
    return best


def _lines(text: str) -> Iterator[str]:
    """Lines by any line end, quoted ones too, one at a time."""
    at = 0
    for m in _BREAK.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def looks_delimited(text: str) -> bool:
    head = text[:SNIFF_CHARS]
    if "\0" in head:
        return False
    d = sniff_delimiter(head)
    return any(_bare(x).count(d) + 1 >= LEAST_FIELDS for x in _lines(head))


def grid(text: str) -> list[list[str | None]]:
    """Rows that hold something, cells trimmed, blank cells null and in their place."""
    body = text.removeprefix("﻿")
    rows = _fields(body, sniff_delimiter(body))
    return [[c.strip() or None for c in r] for r in rows if any(c.strip() for c in r)]


@F.pandas_udf(BooleanType())
def _delimited(heads: pd.Series) -> pd.Series:
    return heads.map(lambda b: looks_delimited(bytes(b).decode("utf-8", "replace")))


def format_of(content: Column) -> Column:
    """xlsx, xls, delimited or unsupported, by content. Only the head of a file goes to the text test."""
    magic = F.hex(F.substring(content, 1, 8))
    return F.when(magic.startswith(ZIP), "xlsx").when(magic == OLE2, "xls").when(_delimited(F.substring(content, 1, 4 * SNIFF_CHARS)), "delimited").otherwise("unsupported")


def sniff_format(files: DataFrame) -> DataFrame:
    """(file_id, format); the file's name decides nothing."""
    return files.select("file_id", format_of(F.col("content")).alias("format"))


CELLS = pa.schema([("file_id", pa.string()), ("row_idx", pa.int32()), ("col_idx", pa.int32()), ("cell", pa.string())])


def _cell_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of files (file_id, content). Small files share a batch, which costs as much as one of them does."""

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), CELLS.types, strict=True)], schema=CELLS)

    cells = []
    for b in batches:
        for file_id, content in zip(b["file_id"].to_pylist(), b["content"].to_pylist(), strict=True):
            cells += [(file_id, i, j, c) for i, r in enumerate(grid(bytes(content or b"").decode("utf-8", "replace"))) for j, c in enumerate(r) if c is not None]
            if len(cells) >= BATCH_CELLS:
                yield batch()
                cells = []
    if cells:
        yield batch()


def read_delimited(files: DataFrame) -> DataFrame:
    """(file_id, row_idx, col_idx, cell) of the cells that hold something."""
    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(_cell_batches, "file_id string, row_idx int, col_idx int, cell string")


def is_number_cell(cell: Column) -> Column:
    return cell.rlike(rf"^{_NUMBER.pattern}$")
