"""Exact top-k by inner product, with bounds from segment means and deviations, coarse to fine.

For a segment of length L, <q, x> = L * mean_q * mean_x + <q - mean_q, x - mean_x> <= L * (mean_q * mean_x + dev_q * dev_x), by Cauchy-Schwarz;
the same statistics bound the distance from below. The bounds of 1, 4, 16 and 32 segments are taken in turn over the pairs still open. The candidates of
the highest bounds give a first floor of k exact scores; of the others, those over the floor get the exact product of their first components beside the bound
of the rest, and those still over it the whole product. The floor of a query is kept for the next block of the task.

Queries and candidates are packed into blocks of bounded size; every block of candidates meets every block of queries once, as the job is
a stated query set against all rows. They meet in a grid of cells, each a bounded run of query blocks and a shard of the candidates; its sides are chosen by the tables' rows, so that
least is sent. Both sides are exchanged, never broadcast: the copies of the queries, one a shard, would pass the driver together. A block pair gives at most k + 1 rows a query, the query's own row among them, and a window keeps the best
k of all others. Query rows of one id are told apart by a row number.

Edge cases: vectors null or holding null or non-finite components take no part; shorter vectors count as padded by zeros; ties go to the smaller
id; repeated ids are separate rows: each query row has its own k and leaves out one candidate of its id and vector, itself; fewer than k candidates give fewer rows; an empty table gives
an empty result; scores beyond a long are held at its ends, where they tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 10
#: Segments of each level; no level has more than half as many as a vector has components.
SEGMENTS = (1, 4, 16, 32)
BLOCK_ROWS, QUERY_ROWS = 4_096, 512
#: Blocks of a cell of the grid at most, of queries and (on average) of candidates.
CELL_QUERIES, CELL_BLOCKS = 8, 16
#: Queries whose bounds are taken together.
QUERY_GROUP = 32
SCALE = 1024.0

_BLOCK = pa.schema([("part", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("nums", pa.binary()), ("data", pa.binary())])


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def part_of(id_col: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(parts)).cast("int")


def blocks(vectors: DataFrame, parts: int, rows: int) -> DataFrame:
    """(part, width, ids, nums, data) of (vec_id, embedding) and num, if there: at most `rows` integer vectors each, as doubles holding whole numbers; ids are hashed to parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part_of = np.asarray(b.column(3))
            for part in np.unique(part_of):
                own = b.take(pa.array(np.flatnonzero(part_of == part)))
                for at in range(0, own.num_rows, rows):
                    some = own.slice(at, rows)
                    ids, lists, nums = np.asarray(some.column(0), dtype=np.int64), some.column(1), np.asarray(some.column(2), dtype=np.int64)
                    lens = np.asarray(lists.value_lengths())
                    width = max(1, int(lens.max()))
                    data = np.zeros((len(ids), width))
                    data[np.arange(width) < lens[:, None]] = np.floor(np.asarray(lists.flatten(), dtype=np.float64) * SCALE)
                    yield pa.RecordBatch.from_pylist([{"part": int(part), "width": width, "ids": ids.tobytes(), "nums": nums.tobytes(), "data": data.tobytes()}], schema=_BLOCK)

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), F.col("num") if "num" in vectors.columns else F.lit(0).alias("num")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    return chosen.withColumn("part", part_of("vec_id", parts)).mapInArrow(run, "part int, width int, ids binary, nums binary, data binary")


def _stats(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and deviations of the segments of each row."""
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    size = np.diff(edges).astype(np.float64)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / size
    square = np.add.reduceat(x * x, edges[:-1], axis=1) / size
    return size, mean, np.sqrt(np.maximum(square - mean * mean, 0))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row inner products of whole numbers, exact: doubles while all sums fit, Python's integers beyond."""
    top = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if top < 2**53:
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    big = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([max(-(2**63), min(2**63 - 1, s)) for s in big], dtype=np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def search_blocks(
    q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, segments=SEGMENTS, floors: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(query's place, ids, scores, whether id and vector are the query's own, exact products) of each query's best k among one block of candidates.

    `floors` holds a score that k candidates of each query are known to reach, over all blocks seen; it is raised in place, so a later block
    gives only what can still count.
    """
    width = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, x))
    floors = np.full(len(q), -np.inf) if floors is None else floors
    levels = [(_stats(q, s), _stats(x, s)) for s in dict.fromkeys(min(s, max(1, width // 2)) for s in segments)]
    norms = np.linalg.norm(x, axis=1)
    slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * norms[None] + 1e-6  # bounds are rounded, products are not
    half = len(levels[-1][0][0]) // 2  # segments in the first half of the finest level
    cut = int(levels[-1][0][0][:half].sum())  # and the components under them
    fits = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < 2**53
    for at in range(0, len(q), QUERY_GROUP):
        group = slice(at, at + QUERY_GROUP)
        columns = np.arange(len(ids))  # candidates open to some query of the group
        for (size, qm, qd), (_, xm, xd) in levels:
            bound = (qm[group] * size) @ xm[columns].T + (qd[group] * size) @ xd[columns].T + slack[group][:, columns]
            alive = (bound >= floors[group, None]).any(axis=0)
            columns, bound = columns[alive], bound[:, alive]
        (size, qm, qd), (_, xm, xd) = levels[-1]
        rest = (qm[group, half:] * size[half:]) @ xm[columns, half:].T + (qd[group, half:] * size[half:]) @ xd[columns, half:].T + slack[group][:, columns]
        for g in range(len(bound)):
            i, done = at + g, 0
            places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
            open_ = np.flatnonzero(bound[g] >= floors[i])
            if len(open_) > 4 * k:  # those of the highest bounds first: k exact scores of theirs make a high floor
                lead = np.argpartition(-bound[g, open_], 4 * k)[: 4 * k]
                first = columns[open_[lead]]
                scores, places, done = _exact(np.broadcast_to(q[i], (len(first), width)), x[first]), first, len(first)
                floors[i] = max(floors[i], np.partition(scores, -k)[-k])
                open_ = np.delete(open_, lead)
                open_ = open_[bound[g, open_] >= floors[i]]
            if fits and cut:  # the first components exactly, the others still by their bounds
                part = x[columns[open_], :cut] @ q[i, :cut]
                open_ = open_[part + rest[g, open_] >= floors[i]]
            left = columns[open_]
            scores = np.concatenate([scores, _exact(np.broadcast_to(q[i], (len(left), width)), x[left])])
            places, done = np.concatenate([places, left]), done + len(left)
            if len(scores) >= k:
                floors[i] = max(floors[i], np.partition(scores, -k)[-k])
            high = np.flatnonzero(scores >= floors[i])
            found = high[_best(scores[high], ids[places[high]], k)]
            names = ids[places[found]]
            yield i, names, scores[found], (names == q_ids[i]) & (x[places[found]] == q[i]).all(axis=1), done


_HITS = pa.schema([("query_id", pa.int64()), ("num", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("own", pa.int32())])


def grid(asking: int, held: int, tasks: int) -> tuple[int, int]:
    """Groups of query blocks and shards of candidates. As many cells as tasks, if there are so many pairs of blocks; the candidates are sent once a group, the queries once a shard."""
    blocks_of = lambda n, rows: 1 + n // rows
    parts, offered = blocks_of(asking, QUERY_ROWS), blocks_of(held, BLOCK_ROWS)
    cells = min(tasks, parts * offered)
    groups = min(parts, max(-(-parts // CELL_QUERIES), round(math.sqrt(cells * asking / max(1, held)))))
    return groups, max(-(-cells // groups), blocks_of(held, CELL_BLOCKS * BLOCK_ROWS))


def topk(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query row over all vectors but itself."""
    # equal rows of an id can stand for each other, so the numbers are the same whenever they are computed
    queries = queries.select("vec_id", "embedding", F.row_number().over(W.partitionBy("vec_id").orderBy("embedding")).alias("num"))
    # a grid: each block of queries is sent to every shard of candidates, each block of candidates to every group of query blocks
    asking, held = queries.count(), vectors.count()
    parts = 1 + asking // QUERY_ROWS
    groups, shards = grid(asking, held, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a block's rows lie together: dealt by the part that they are cut by, and in its order
    dealt = queries.repartition(parts, part_of("vec_id", parts)).sortWithinPartitions(part_of("vec_id", parts))
    asked = blocks(dealt, parts, QUERY_ROWS).select(
        F.pmod("part", F.lit(groups)).alias("q"), F.col("width").alias("qw"), F.col("ids").alias("qi"), F.col("nums").alias("qn"), F.col("data").alias("qx"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    )
    offered = blocks(vectors, 1, BLOCK_ROWS).withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    offered = offered.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # cells are few bytes and much work, so they are not put together by bytes; and the size of exploded blocks is misjudged, by which they would be broadcast
    offered, asked = (side.repartition(groups * shards, "q", "shard") for side in (offered, asked))
    met = offered.join(asked.hint("merge"), ["q", "shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[bytes, np.ndarray] = {}  # of each block of queries, over the candidates that this task has seen
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in ("width", "ids", "data", "qw", "qi", "qn", "qx")}
                q_ids, nums, ids = (np.frombuffer(row[c], np.int64) for c in ("qi", "qn", "ids"))
                q, x = np.frombuffer(row["qx"]).reshape(-1, row["qw"]), np.frombuffer(row["data"]).reshape(-1, row["width"])
                known = floors.setdefault(row["qi"] + row["qn"], np.full(len(q_ids), -np.inf))
                for i, found, scores, own, _ in search_blocks(q_ids, q, ids, x, k + 1, floors=known):
                    key = [pa.array([v[i]] * len(found), pa.int64()) for v in (q_ids, nums)]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(found), pa.array(scores), pa.array(own.astype(np.int32))], schema=_HITS)

    hits = met.mapInArrow(run, "query_id long, num long, vec_id long, score long, own int")
    best = W.partitionBy("query_id", "num").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    top = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    # the first of a query's own rows is the query itself; others are its copies
    passed = top.withColumn("passed", F.sum("own").over(best.rowsBetween(W.unboundedPreceding, W.currentRow)))
    others = passed.filter("own = 0 or passed > 1").withColumn("rank", (F.col("place") - F.least("passed", F.lit(1))).cast("int"))
    return others.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
