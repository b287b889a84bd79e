"""SimHash near-dedup: exact links between 64-bit fingerprints by bit-sliced comparison, and their components.

A fingerprint's bit is one where over half of the text's shingle hashes have it. Equal fingerprints are one node, so copies cost nothing further. Fingerprints that differ in at most `radius` bits
agree in all bits of some g - radius of g blocks: each choice of blocks is a table keyed by their bits, and only nodes of one key are compared. No link is lost, whatever g. g is the first for which the
average node meets few enough others, told by counts over all keys, so wide data get longer keys and the same links.

Inside a key the fingerprints are stored as bit planes, 64 to a word. A query's distances to all of them grow plane by plane in carry-save counters (two planes a step), which start so that the top carry says
"over the radius". Blocks of 64 whose fingerprints have all gone over are abandoned. A key with many nodes is cut by hash into chunks and each pair of chunks is a tile of its own, so a hot key is spread over tasks.
A tile gives out one link for each node that it joins to another, never its pairs.

Edge cases: a null or empty text, or one without words, has the fingerprint zero, linked like any other; fewer words than a shingle are one shingle; repeated rows are copies; a null doc_id takes part, and
is a component's id only if all of it is null; an empty table gives an empty result; no other column is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, written
from .dartminhash import components

WORDS, RADIUS, SEED = 4, 4, 42
#: Nodes of a key in one chunk; queries compared at once; nodes that the average node may meet in a key before keys get longer.
CHUNK, QUERIES, MEET = 4_096, 64, 8_192
#: Bytes of a text that are split into words at once.
PART = 1 << 20
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(data: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    at = 0
    while len(data) - at > PART:
        found = _SPACE.search(data, at + PART)
        if not found:
            break
        yield data[at : found.start()]
        at = found.start()
    yield data[at:]


def fingerprint(data: bytes, words: int = WORDS) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text. A-Z are lowered; words are what white space (space, tab to carriage return) parts."""
    ones, total, held = np.zeros(64, np.int64), 0, []
    for part in _parts(data):
        held += part.lower().split()  # of bytes: these lower and part exactly the characters named
        n = len(held) - words + 1
        if n > 0:
            h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*(held[k : n + k] for k in range(words)), strict=True)), repeat(SEED)), np.uint64, n)
            ones += np.unpackbits(h.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0, np.int64)
            total += n
            held = held[n:]
    if not total and held:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(held), SEED)).view(np.int64))
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), words) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- bit planes


def planes_of(fps: np.ndarray) -> np.ndarray:
    """64 rows of words: bit i of word w of row b is bit b of fingerprint 64 w + i."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(len(fps), 8), axis=1, bitorder="little")
    wide = np.zeros((64, -(-len(fps) // 64) * 64), np.uint8)
    wide[:, : len(fps)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _add_two(counters: list[np.ndarray], over: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Add two bits of every lane: a carry-save step in the lowest counter, then its carry ripples up; what leaves the top stays in `over`."""
    if not counters:
        over |= x | y
        return
    low = counters[0]
    half = low ^ x
    carry = (low & x) | (half & y)
    np.bitwise_xor(half, y, out=low)
    for c in counters[1:]:
        up = c & carry
        c ^= carry
        carry = up
    over |= carry


def within(queries: np.ndarray, planes: np.ndarray, n: int, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, fingerprint) places whose distance over `bits` is at most `radius`. All other bits must be equal.

    Counters of k bits start at 2^k - 1 - radius, so that the carry out of the top tells a distance over the radius.
    """
    k = radius.bit_length()
    start = (1 << k) - 1 - radius
    wide = np.uint64(0) - ((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))  # a word of ones where the query's bit is one
    q, w = (x.ravel() for x in np.indices((len(queries), planes.shape[1])))
    counters = [np.full(len(q), _FULL if start >> j & 1 else 0, np.uint64) for j in range(k)]
    over = np.zeros(len(q), np.uint64)
    if n % 64:  # lanes without a fingerprint
        over[w == planes.shape[1] - 1] = _FULL << np.uint64(n % 64)
    for i in range(0, len(bits), 2):
        x = planes[bits[i]][w] ^ wide[q, bits[i]]
        y = planes[bits[i + 1]][w] ^ wide[q, bits[i + 1]] if i + 1 < len(bits) else np.zeros_like(x)
        _add_two(counters, over, x, y)
        if i % 8 == 6 and i > 12:
            live = np.flatnonzero(over != _FULL)
            if len(live) < len(over) * 0.75:  # blocks of 64 that have all gone over are abandoned
                q, w, over, counters = q[live], w[live], over[live], [c[live] for c in counters]
                if not len(live):
                    break
    hit = np.flatnonzero(np.unpackbits((~over).view(np.uint8), bitorder="little"))
    return q[hit // 64], w[hit // 64] * 64 + hit % 64


def joined(left: np.ndarray, right: np.ndarray | None, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): of the links among `left`, or between `left` and `right`, one for each node that isn't its component's root."""
    nodes = left if right is None else np.concatenate([left, right])
    others, shift = (left, 0) if right is None else (right, len(left))
    planes, label = planes_of(others), np.arange(len(nodes))
    for at in range(0, len(left), QUERIES):
        q, c = within(left[at : at + QUERIES], planes, len(others), radius, bits)
        q, c = q + at, c + shift
        while True:
            a, b = label[q], label[c]
            apart = a != b
            if not apart.any():
                break
            q, c, a, b = q[apart], c[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(up := label[label], label):
                label = up
    moved = np.flatnonzero(label != np.arange(len(label)))
    return nodes[moved], nodes[label[moved]]


# --- tables of keys


def tables(g: int, radius: int) -> list[int]:
    """The masks of every choice of g - radius of g blocks."""
    edges = [64 * i // g for i in range(g + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(g)]
    return [sum(c) for c in combinations(blocks, g - radius)]


def keyed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(t, k, fp): every node once for each table."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)])
    return nodes.select("fp", F.explode(keys).alias("key")).select("key.t", "key.k", "fp")


def tiles(rows: DataFrame, sizes: DataFrame, chunk: int) -> DataFrame:
    """(t, k, lo, hi, side, fp): the nodes of each key that has company, once for each tile of two chunks that they are in."""
    many = rows.join(sizes, ["t", "k"])
    n = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), n).cast("int")
    dealt = many.select("t", "k", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
    return dealt.select("t", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(table, sides, fingerprints) of each tile of a sorted stream; the last one of a batch waits for the next."""
    held = None
    for b in batches:
        rows = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("t", "k", "lo", "hi", "side", "fp")])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        cuts = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(0)) + 1
        for lo, hi in zip(np.append(0, cuts[:-1]), cuts, strict=True) if len(cuts) else ():
            yield int(rows[0, lo]), rows[4, lo:hi], rows[5, lo:hi]
        held = rows[:, cuts[-1] :] if len(cuts) else rows
    if held is not None and held.shape[1]:
        yield int(held[0, 0]), held[4], held[5]


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK, meet: int = MEET) -> DataFrame:
    """(a, b): links that join all of the nodes (fp) that chains of at most `radius` differing bits connect."""
    for g in range(radius + 1, radius + 5):
        masks = tables(g, radius)
        rows = keyed(nodes, masks)
        sizes = cut(rows.groupBy("t", "k").agg(F.count("*").alias("n")).filter("n > 1"))
        met = sizes.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
        if (met["pairs"] or 0) <= meet * (met["rows"] or 1):
            break
    free = [[b for b in range(64) if not m >> b & 1] for m in masks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, side, fps in _groups(batches):
            fps = np.ascontiguousarray(fps).view(np.uint64)
            right = fps[side == 1]
            a, b = joined(fps[side == 0], right if side.any() else None, radius, free[t])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    place = ["t", "k", "lo", "hi"]
    return tiles(rows, sizes, chunk).repartition(*place).sortWithinPartitions(*place, "side").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, words: int = WORDS, chunk: int = CHUNK, meet: int = MEET) -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id that links lead to, its own included."""
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    roots = components(cut(links(nodes.select("fp"), radius, chunk, meet)))
    named = nodes.join(roots.withColumnRenamed("key", "fp"), "fp", "left")
    classes = named.filter("root is not null").groupBy("root").agg(F.min("first").alias("least"))
    # only fingerprints of several rows or with links need a look-up
    known = named.filter("copies > 1 or root is not null").join(classes, "root", "left").select("fp", F.coalesce("least", "first").alias("c"))
    return prints.join(known, "fp", "left").select("doc_id", "fp", F.coalesce("c", "doc_id").alias("component_id"))
