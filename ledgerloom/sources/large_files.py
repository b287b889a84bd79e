"""Delimited files of any size, one file over many tasks, and any number of small files in common ones.

A file is read in splits by Spark's text reader, a run of lines each, of bounded length. Whether a line end ends a row depends on the quotes before it, all the way from the file's start, but only on whether they are odd or even. So
a first pass gives each run's parity, a running sum over runs gives the state at each run's start, and a second pass parses all runs side by side. A row that goes over the end of a run is its open end there
and the opening lines of the runs behind, which are put together and parsed on their own. Rows are numbered by running sums over runs, too. A run's lines, and then its cells, cross the network as one row.

A file costs a store more than its lines do, so small ones are kept in common files (`pack_files`): one after the other, each line behind its file's name. These are split at any line, as others are.

Same answers as `files.read_delimited`, of which a file is one task. Files are UTF-8; other bytes are replaced. A quote that is never closed makes the rest of its file one cell, as it does there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .files import BATCH_CELLS, _fields, sniff_delimiter
from .shared import written

#: Lines and bytes that are parsed together, at most; a longer line is alone.
PARSED_LINES, RUN_BYTES = 2_000, 1 << 20
#: Lines, blank ones among them, of which a sniff of the delimiter takes the first.
HEAD_LINES = 400

CHUNK = ["file_id", "block"]
RUNS = pa.schema([("file_id", pa.string()), ("block", pa.int64()), ("text", pa.string()), ("head", pa.string()), ("delimiter", pa.string())])
CELL = pa.struct([("i", pa.int32()), ("col_idx", pa.int32()), ("cell", pa.string())])
PIECES = pa.schema([("file_id", pa.string()), ("block", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("text", pa.string()), ("cells", pa.list_(CELL))])


def pack_files(files: DataFrame, path: str) -> None:
    """Writes files (file_id, text), whose ids differ, into common files, as many as the tasks that have them."""
    name = F.concat(F.url_encode("file_id"), F.lit("\t"))
    lines = F.concat(name, F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.concat(F.lit("\n"), name)))
    files.select(lines.alias("value")).write.text(path)


def read_lines(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file_id, block, pos, line, store, whole): lines by line feed alone, in their order inside a block, which is a split of the file `store`; `whole` says that the split goes to that file's end."""
    at = F.col("_metadata.file_block_start")
    name = F.substring_index("value", "\t", 1)
    file_id, line = (name, F.substr("value", F.length(name) + 2)) if packed else (F.col("_metadata.file_path"), F.col("value"))
    ends = at + F.col("_metadata.file_block_length") >= F.col("_metadata.file_size")
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(file_id.alias("file_id"), at.alias("block"), F.monotonically_increasing_id().alias("pos"), line.alias("line"), F.col("_metadata.file_path").alias("store"), ends.alias("whole"))


def _lines_to_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RUNS of lines as a split gives them. Where a file begins, and its head is whole, the delimiter is sniffed at once; else the head goes along."""
    now, starts, held, size, place, at, seen, rows, out_size = None, False, [], 0, 0, 0, 0, [], 0

    def close(ends: bool) -> None:
        nonlocal held, size, seen, out_size
        if held:
            head = delimiter = None
            if seen < HEAD_LINES:
                head = b"\n".join(held[: HEAD_LINES - seen]).decode("utf-8", "replace")
                if starts and not seen and (ends or len(held) >= HEAD_LINES):
                    head, delimiter = None, sniff_delimiter(head.removeprefix("﻿"))
            rows.append((now[2], place, b"\n".join(held).decode("utf-8", "replace"), head, delimiter))
            seen += len(held)
            out_size += size
            held, size = [], 0

    def batch() -> pa.RecordBatch:
        nonlocal rows, out_size
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), RUNS.types, strict=True)], schema=RUNS)
        rows, out_size = [], 0
        return out

    whole = False
    for b in batches:
        keys = [b[c] for c in ("store", "block", "file_id")]
        ends = np.cumsum(pc.binary_length(b["line"]).to_numpy(zero_copy_only=False).astype("int64") + 1)
        a = 0
        for z in sorted({int(z) for k in keys for z in pc.run_end_encode(k).run_ends.to_pylist()}):
            found = tuple(k[a].as_py() for k in keys)
            if found != now:
                same = now is not None and found[:2] == now[:2]
                close(same or whole)
                at = at if same else found[1]
                now, starts, seen, place, whole = found, same or found[1] == 0, 0, at, b["whole"][a].as_py()
            while a < z:
                done = int(ends[a - 1]) if a else 0
                cut = min(z, a + PARSED_LINES - len(held), int(np.searchsorted(ends, done + RUN_BYTES - size, "right")))
                if cut <= a and held:
                    close(False)
                    place = at
                    continue
                cut = max(cut, a + 1)
                held += b["line"].slice(a, cut - a).to_pylist()
                size, at, a = size + int(ends[cut - 1]) - done, at + int(ends[cut - 1]) - done, cut
                if len(held) >= PARSED_LINES or size >= RUN_BYTES:
                    close(False)
                    place = at
                if out_size >= 4 * RUN_BYTES:
                    yield batch()
    close(whole)
    if rows:
        yield batch()


def read_runs(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file_id, block, text, head, delimiter): runs of lines, `block` being each run's place. Heads are there where the delimiter isn't known yet."""
    lines = read_lines(spark, path, packed).select("file_id", "block", F.col("line").cast("binary").alias("line"), "store", "whole")
    runs = lines.mapInArrow(_lines_to_runs, "file_id string, block long, text string, head string, delimiter string")
    return runs.withColumn("file_id", F.url_decode("file_id")) if packed else runs


def chunk_states(lines: DataFrame, text: str = "line") -> DataFrame:
    """(file_id, block, inside, first): whether a chunk begins inside of quotes, and whether it is its file's first. One row a chunk is sorted, no line."""
    quotes = F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit('"'), F.lit("")))
    odd = lines.groupBy(*CHUNK).agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = F.sum("odd").over(W.partitionBy("file_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    return odd.select(*CHUNK, (F.coalesce(before, F.lit(0)) % 2 == 1).alias("inside"), before.isNull().alias("first"))


def delimiters(runs: DataFrame) -> DataFrame:
    """(file_id, delimiter): as its first run says, or sniffed from the heads of a file's runs."""
    place = F.row_number().over(W.partitionBy("file_id").orderBy("block"))  # a limit by row number is taken in every task first
    some = runs.filter("head is not null or delimiter is not null").withColumn("n", place).filter(F.col("n") <= HEAD_LINES)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("head").isNotNull(), F.struct("n", "head")))), lambda x: x["head"]), "\n")
    sniffed = F.pandas_udf(lambda s: s.map(lambda t: sniff_delimiter((t or "").removeprefix("﻿"))), "string")
    heads = some.groupBy("file_id").agg(F.max("delimiter").alias("known"), text.alias("heads"))
    return heads.filter("known is not null").select("file_id", F.col("known").alias("delimiter")).union(heads.filter("known is null").select("file_id", sniffed("heads")))


def _cells(text: str, delimiter: str) -> tuple[int, list[tuple[int, int, str]]]:
    """How many rows of `text` hold something, and (row, column, cell) of what they hold; blank rows have no number."""
    out, n = [], 0
    for row in _fields(text, delimiter):
        bare = [(j, c.strip()) for j, c in enumerate(row)]
        kept = [(n, j, c) for j, c in bare if c]
        if kept:
            out += kept
            n += 1
    return n, out


def _cut(text: str, inside: bool) -> tuple[str | None, str | None, str | None]:
    """A run's opening lines that end a row begun before, its complete rows, and its open end."""
    if not inside and not text.count('"') & 1:
        return None, text, None
    lines, odd, evens = text.split("\n"), int(inside), []
    for k, line in enumerate(lines):
        odd ^= line.count('"') & 1
        if not odd:
            evens.append(k + 1)
    if not evens:
        return (text, None, None) if inside else (None, None, text)
    a, z = evens[0] if inside else 0, evens[-1]
    put = lambda some: "\n".join(some) if some else None
    return put(lines[:a]), put(lines[a:z]), put(lines[z:])


def _batch(rows: list[tuple], cells: list[list[tuple]]) -> pa.RecordBatch:
    """PIECES of rows without their cells, and the cells of each."""
    flat = [c for some in cells for c in some]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in cells])]), pa.int32())
    columns = list(zip(*flat, strict=True)) if flat else [()] * 3
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, CELL, strict=True)], fields=list(CELL))
    outer = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), PIECES.types[:-1], strict=True)]
    return pa.RecordBatch.from_arrays([*outer, pa.ListArray.from_arrays(offsets, inner)], schema=PIECES)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run, cells of the rows that begin and end in it (part 0), and its opening lines (part -1) and open end (part 1) as pieces of text. Runs that are joined rows have cells only, as part 1."""
    rows, cells, held = [], [], 0
    for b in batches:
        for file_id, block, part, text, inside, first, mark in zip(*(b[c].to_pylist() for c in ("file_id", "block", "part", "text", "inside", "first", "delimiter")), strict=True):
            opening, whole, end = _cut(text.removeprefix("﻿") if first else text, inside) if part == 0 else (None, text, None)
            for p, piece in ((-1, opening), (1, end)):
                if piece is not None:
                    rows.append((file_id, block, p, 0, piece))
                    cells.append([])
            if whole is not None:
                n, found = _cells(whole + "\n", mark)
                rows.append((file_id, block, part, n, None))
                cells.append(found)
                held += len(found)
            if held >= BATCH_CELLS or len(rows) >= BATCH_CELLS:
                yield _batch(rows, cells)
                rows, cells, held = [], [], 0
    if rows:
        yield _batch(rows, cells)


def _parsed(runs: DataFrame) -> DataFrame:
    """PIECES of (file_id, block, part, text, inside, first, delimiter)."""
    kept = runs.select("file_id", "block", "part", "text", "inside", "first", "delimiter")
    return kept.mapInArrow(_pieces, "file_id string, block long, part int, n int, text string, cells array<struct<i: int, col_idx: int, cell: string>>")


def _joined_rows(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """PIECES of the rows that go over the ends of runs, under the run where they begin (part 1)."""
    begun = F.sum((F.col("part") == 1).cast("int")).over(W.partitionBy("file_id").orderBy("block", "part"))
    grouped = pieces.withColumn("g", begun).groupBy("file_id", "g").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("block", "part", "text"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    return _parsed(grouped.select("file_id", "block", F.lit(1).alias("part"), text.alias("text"), F.lit(False).alias("inside"), F.lit(False).alias("first")).join(marks, "file_id"))


def read_delimited_files(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """(file_id, row_idx, col_idx, cell) of the cells that hold something, of files that Spark can split, or of files that `pack_files` has written."""
    runs = written(read_runs(spark, path, packed), "runs")
    marks = written(delimiters(runs), "delimiters")
    told = runs.select(*CHUNK, F.lit(0).alias("part"), "text").join(chunk_states(runs, "text").join(marks, "file_id"), CHUNK)
    pieces = written(_parsed(told), "pieces")
    joined = written(_joined_rows(pieces.filter("part != 0").select(*CHUNK, "part", "text"), marks), "joined")
    rows = pieces.filter("part = 0").union(joined)
    before = F.sum("n").over(W.partitionBy("file_id").orderBy("block", "part").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.select(*CHUNK, "part", F.coalesce(before, F.lit(0)).alias("before"))
    cells = rows.select(*CHUNK, "part", "cells").join(placed, [*CHUNK, "part"]).select("file_id", "before", F.inline("cells"))
    return cells.select("file_id", (F.col("before") + F.col("i")).cast("int").alias("row_idx"), "col_idx", "cell")
