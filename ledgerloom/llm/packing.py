"""Packing into length buckets whose bounds a dynamic programme picks over the global length histogram.

The histogram has a bin for each length to 256 and 64 for each doubling beyond, with its rows, its tokens and its greatest length. Padding is counted exactly; bounds
are picked among the bins' greatest lengths, so beyond 256 tokens the best bounds of all may be up to a 64th away from those taken.

Edge cases: a null or empty text has no tokens and sits in the first bucket; a text longer than the token budget is a batch
of its own, never cut or dropped; equal lengths and repeated rows are ordered by a hash of the id and the text and may
share a batch; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

BUCKETS = 16
TOKEN_BUDGET = 65_536
#: Rows numbered together, on average.
SHARD_ROWS = 16_384


def token_count(text: Column) -> Column:
    """Words and single punctuation marks, the default length measure."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def grid(length: Column) -> Column:
    """The length rounded up: exact to 256, then in steps of 1/64 of its power of two. At most 256 + 64 * 55 bins exist, whatever the corpus."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))) - 6, F.lit(0))).cast("long")
    return F.when(length <= 256, length).otherwise(F.ceil(length / step).cast("long") * step)


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int, tokens: list[int] | None = None) -> list[int]:
    """The upper bounds, at most `buckets`, that minimise the padding, for bins of `counts` rows, `lengths` at most and `tokens` in all (of equal lengths, if not given).

    cost(i, j) = bound_j * rows(i..j) - tokens(i..j); the last bound is the greatest length. The first of equal optima is taken.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x = np.asarray(lengths, dtype=np.float64)[order]
    rows = np.concatenate([[0.0], np.cumsum(np.asarray(counts, dtype=np.float64)[order])])
    held = np.asarray(counts, dtype=np.float64)[order] * x if tokens is None else np.asarray(tokens, dtype=np.float64)[order]
    tokens = np.concatenate([[0.0], np.cumsum(held)])
    n, k = len(x), min(buckets, len(x))
    best = np.concatenate([[0.0], x * rows[1:] - tokens[1:]])  # one bucket
    cuts = [np.zeros(n + 1, dtype=np.int64)]
    for _ in range(1, k):
        new, came = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            i = int(np.argmin(cost))
            if cost[i] < best[j]:
                new[j], came[j] = cost[i], i
        cuts.append(came)
        best = new
    bounds, j, level = [], n, k - 1
    while j > 0:
        while level > 0 and cuts[level][j] < 0:
            level -= 1
        bounds.append(int(x[j - 1]))
        j = int(cuts[level][j]) if level else 0
        level -= 1
    return bounds[::-1]


def _copies(rows: DataFrame) -> DataFrame:
    """Each row `__n` times, numbered from `__first` in `__at`. A row repeated very often is cut into runs that are dealt over all tasks before they are written out."""
    run = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(SHARD_ROWS).cast("long"))).alias("__run")
    every = F.explode(F.sequence(F.col("__run"), F.least(F.col("__run") + SHARD_ROWS, F.col("__n")) - 1)).alias("__c")
    few = rows.filter(F.col("__n") <= SHARD_ROWS).withColumn("__run", F.lit(0).cast("long"))
    many = rows.filter(F.col("__n") > SHARD_ROWS).select("*", run).repartition("__first", "__run")
    return few.unionByName(many).select("doc_id", "n_tokens", "bucket", "__first", every).withColumn("__at", F.col("__first") + F.col("__c"))


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None
) -> DataFrame:
    """A row per document: doc_id, n_tokens, bucket, bound, batch, slot.

    `batch` numbers the batches inside a bucket; a batch holds at most budget // bound documents (one at least), each padded
    to `bound`. Rows are numbered over hash shards: a small count table gives each shard its offset, so no task numbers a
    whole bucket and only the last batch of a bucket may be short.
    """
    length = token_count(F.col(text_col)) if length is None else length
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), length.alias("n_tokens"), F.xxhash64(F.col(id_col), text).alias("__o"))
    # rows that repeat id and text are one row with a number from here on, wherever they lie
    sized = cut(rows.groupBy("doc_id", "n_tokens", "__o").agg(F.count("*").alias("__n")).withColumn("__g", grid(F.col("n_tokens"))))
    bins = sized.groupBy("__g").agg(F.sum("__n").alias("n"), F.max("n_tokens").alias("most"), F.sum(F.col("n_tokens") * F.col("__n")).alias("held")).collect()  # bounded by the grid, not by the corpus
    bounds = optimal_bounds([r["most"] for r in bins], [r["n"] for r in bins], buckets, [r["held"] for r in bins])
    shards = max(1, -(-sum(r["n"] for r in bins) // SHARD_ROWS))  # by the rows alone, so the same batches come of any cluster
    at = F.lit(None).cast("int")
    for i in reversed(range(len(bounds))):
        at = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(at)
    placed = sized.withColumn("bucket", at).withColumn("__s", F.pmod("__o", F.lit(shards)).cast("int"))
    counts = placed.groupBy("bucket", "__s").agg(F.sum("__n").alias("n"))
    # the count table has a row per bucket and shard
    before = counts.select("bucket", "__s", (F.sum("n").over(W.partitionBy("bucket").orderBy("__s")) - F.col("n")).alias("__before"))
    in_shard = W.partitionBy("bucket", "__s").orderBy("__o", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbered = placed.withColumn("__first", F.sum("__n").over(in_shard) - F.col("__n")).join(before, ["bucket", "__s"])
    joined = _copies(numbered.select("doc_id", "n_tokens", "bucket", (F.col("__before") + F.col("__first")).alias("__first"), "__n"))
    bound = F.element_at(F.array(*[F.lit(b) for b in bounds]).cast("array<long>"), F.col("bucket") + 1) if bounds else F.lit(None).cast("long")
    room = F.greatest(F.expr(f"{budget} div greatest(bound, 1)"), F.lit(1)).cast("long")
    at0 = F.col("__at")
    return (
        joined.withColumn("bound", bound).withColumn("__room", room)
        .select("doc_id", "n_tokens", "bucket", "bound", F.floor(at0 / F.col("__room")).cast("long").alias("batch"), (at0 % F.col("__room")).cast("long").alias("slot"))
    )
