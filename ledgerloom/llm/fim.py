"""Fill-in-the-middle: texts cut into units and put together again as prefix, suffix and middle, in a pyarrow.compute pipeline.

Spark takes the count of units, the two cuts and the form from a hash of the id, so a row's result depends on that row alone. Inside a batch the units of many texts are one
list array over the text's own bytes; flattened with the index of their text they get ordinals, ordinals give roles, the units of a role are rebuilt to lists, and the lists are joined to
pieces. A run of at most `RUN` bytes is expanded at a time, whatever the length of a text; pieces of a text that spans runs are joined at the end.

Units are code points, or with unit="line" lines with their line end. A text is left as it is ("plain") if it is empty, holds a marker, or by its hash falls outside of `percent`. No text holds a
marker and is transformed, and markers neither overlap themselves nor each other, so splitting the output at its markers gives the pieces back exactly.

Edge cases: a null text is an empty one and plain; a null id is hashed as an empty one; repeated rows stay; equal ids are cut by the same hash; an empty table gives an empty result; no other
column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
PERCENT, SPM_PERCENT, SEED = 90, 20, 1
#: Bytes whose units are expanded at once, and bytes of texts in one output batch (a longer text is a batch of its own).
RUN, BATCH = 1 << 20, 4 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def n_units(text: Column, unit: str) -> Column:
    if unit == "char":
        return F.char_length(text).cast("long")
    ends = F.char_length(text) - F.char_length(F.translate(text, "\n", ""))
    return (ends + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("long")


def planned(docs: DataFrame, id_col: str, text_col: str, unit: str, percent: int, spm_percent: int, seed: int) -> DataFrame:
    """(doc_id, text, n, form, a, b): the prefix ends after `a` units and the middle after `b`."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), n_units(text, unit).alias("n"), F.sha2(key.cast("binary"), 256).alias("__h"))
    h = [F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    one, two = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKER) | (h[2] % 100 >= percent)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))


def _starts(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Where the units of bytes lo to hi begin."""
    if unit == "char":
        return lo + np.flatnonzero((data[lo:hi] & 0xC0) != 0x80)
    first = np.zeros(hi - lo, bool)
    first[1:] = data[lo : hi - 1] == 10
    first[0] = lo > 0 and data[lo - 1] == 10
    texts = offsets[(offsets >= lo) & (offsets < hi)]
    first[texts - lo] = True
    return lo + np.flatnonzero(first)


def _run_end(data: np.ndarray, offsets: np.ndarray, lo: int, end: int, unit: str) -> int:
    """The end of the run from `lo`: the first start of a unit that is RUN bytes further, so no unit is cut."""
    at = lo + RUN
    while at < end:
        found = _starts(data, offsets, at, min(at + RUN, end), unit)
        if len(found):
            return int(found[0])
        at += RUN
    return end


def pieces(texts: pa.Array, a: np.ndarray, b: np.ndarray, unit: str = "char") -> list[pa.Array]:
    """The prefixes, middles and suffixes of the texts, by their cuts in units."""
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    rows, found, at, seen, last = [], [[], [], []], int(offsets[0]), 0, -1
    while at < offsets[-1]:
        end = _run_end(data, offsets, at, int(offsets[-1]), unit)
        starts = _starts(data, offsets, at, end, unit)
        # the texts with units in this run
        r0, r1 = int(np.searchsorted(offsets, at, "right")) - 1, int(np.searchsorted(offsets, end, "left"))
        bounds = np.searchsorted(starts, np.clip(offsets[r0 : r1 + 1], at, end)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, end).astype(np.int32)), raw)
        lists = pa.ListArray.from_arrays(pa.array(bounds), units)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        before = bounds[:-1].astype(np.int64)
        if r0 == last:  # a text that goes on from the run before
            before[0] -= seen
        ordinal = pc.subtract(pa.array(np.arange(len(starts))), pc.take(pa.array(before), parent))
        late, last_part = (pc.greater_equal(ordinal, pc.take(pa.array(cut[r0:r1]), parent)) for cut in (a, b))
        for k, role in enumerate((pc.invert(late), pc.and_not(late, last_part), last_part)):
            size = np.bincount(parent.filter(role).to_numpy(), minlength=r1 - r0)
            rebuilt = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), flat.filter(role))
            found[k].append(pc.binary_join(rebuilt, ""))
        rows.append(np.arange(r0, r1))
        seen = int(bounds[-1] - bounds[-2]) + (seen if r1 - 1 == last else 0)
        last, at = r1 - 1, end
    if not rows:
        return [pa.array([""] * n, pa.string())] * 3
    of_row = np.searchsorted(np.concatenate(rows), np.arange(n + 1)).astype(np.int32)  # a text has a piece of each run that it is in
    return [pc.binary_join(pa.ListArray.from_arrays(pa.array(of_row), pa.concat_arrays(p)), "") for p in found]


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, count) with at most BATCH bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        below = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, below + BATCH, "right")), at + 1)
        yield at, to - at
        at = to


def assembled(text: pa.Array, form: pa.Array, a: np.ndarray, b: np.ndarray, unit: str) -> list[pa.Array]:
    """prefix_chars, middle_chars and output of one slice."""
    prefix, middle, suffix = pieces(text, a, b, unit)
    psm = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    is_spm, plain, none = pc.equal(form, "spm"), pc.equal(form, "plain"), pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(p), pa.int64())) for p in (prefix, middle)]
    return [*chars, pc.if_else(plain, text, pc.if_else(is_spm, spm, psm))]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """Each text's training form, by `SCHEMA`: `percent` of the texts are transformed, `spm_percent` of these with the suffix first. Narrow: no row crosses the network."""
    if unit not in ("char", "line"):
        raise ValueError(f"unit must be char or line, not {unit}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, count in _slices(whole.column("text")):
                part = whole.slice(first, count)
                doc, text, n, form, a, b = (part.column(c) for c in ("doc_id", "text", "n", "form", "a", "b"))
                yield pa.RecordBatch.from_arrays([doc, n, form, *assembled(text, form, a.to_numpy(), b.to_numpy(), unit)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return planned(docs, id_col, text_col, unit, percent, spm_percent, seed).mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text that an output of `transform` was made of."""
    part = F.split(output, MARKER, -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
