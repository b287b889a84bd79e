"""The live side: captures as a stream, from raw messages to ledger rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.matching import TIGHT_MS, WIDE_MS
from ..functions.text import DAY_MS
from ..functions.messages import capture_origin, merchant_identity, parse_captures
from ..operators.dedup import Accepted
from ..operators.flows import ledger_rows
from ..sources.captures import MINUTE_MS, prefilter
from ..sources.shared import scratch, written
from .index import MatchIndex
from .sums import DeltaSums, follow

WATERMARK = "12 hours"
#: Shards of users of the near-duplicate state.
SHARDS = 1024


def _timed(captures: DataFrame) -> DataFrame:
    return captures.withColumn("posted_at", F.timestamp_millis("posted_at_ms"))


def stream_dedup(captures: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Messages of a stream that passed the filter, the first of each (user, source, sender, body, minute) within the watermark."""
    keyed = _timed(prefilter(captures)).withColumn("minute", F.floor(F.col("posted_at_ms") / MINUTE_MS))
    kept = keyed.withWatermark("posted_at", watermark).dropDuplicatesWithinWatermark(["user_id", "source", "sender", "body", "minute"])
    return kept.drop("minute", "posted_at")


def stream_ingest(
    captures: DataFrame, checkpoint: str, append: Callable[[DataFrame, int], DataFrame], index: MatchIndex, rows_of: Callable[[DataFrame, MatchIndex], DataFrame] = ledger_rows
) -> StreamingQuery:
    """Run the stream: each batch is deduplicated, matched with the ledger by its standing index, appended to the ledger and added to the index. A batch costs what it holds and meets, not what the ledger holds.

    `append(rows, batch_id)` writes a batch's rows and gives them back as written; it must be idempotent by batch id. A batch that is replayed after a failure is done again if the index doesn't know it, and otherwise left alone.
    `rows_of(messages, index)` makes a batch's rows.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if batch_id > index.last_batch():
            with scratch(index.spark):  # a stream that runs for years leaves nothing behind but its ledger and index
                came = written(rows, "arrived")
                if came.limit(1).count():  # a batch may only move the watermark
                    index.add(append(rows_of(came, index), batch_id), batch_id)

    return stream_dedup(captures).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


class NearDup(StatefulProcessor):
    """Accepted payments of one shard of users: a map from 12-hour bucket to the payments in it, of which a batch reads and writes only those that it reaches, once. A timer for each bucket ends it.

    A call, and each step to the state, costs about as much as a hundred payments do, and most payments are alone with their user, amount and direction: so a key is a shard, and those three a column.
    """

    def __init__(self, tight_ms: int):
        self.tight_ms = tight_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket long", "ids array<long>, payments array<string>, times array<long>, merchants array<string>, origins array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows).sort_values(["posted_at_ms", "id"])
        known, read, changed, out = defaultdict(Accepted), {}, set(), []

        def reach(bucket: int) -> None:
            """Read a bucket's payments, once."""
            if bucket not in read:
                found = self.held.getValue((bucket,)) or ([], [], [], [], [])
                read[bucket] = [list(c) for c in found]
                for i, payment, ms, m, origin in zip(*read[bucket], strict=True):
                    known[payment].add((i, ms, m or None, origin, None, self.tight_ms))

        for i, payment, ms, m, origin in zip(*(batch[c].tolist() for c in ("id", "payment", "ms", "m", "origin")), strict=True):
            own = ms // WIDE_MS
            for b in (own - 1, own, own + 1):
                reach(b)
            row = (i, ms, m if isinstance(m, str) else None, origin, None, self.tight_ms)
            out.append(known[payment].match(row))
            if out[-1] is None:
                known[payment].add(row)
                for column, x in zip(read[own], (i, payment, ms, row[2] or "", origin), strict=True):
                    column.append(x)
                changed.add(own)
        for b in sorted(changed):
            self.held.updateValue((b,), tuple(read[b]))
            self.handle.registerTimer((b + 3) * WIDE_MS)  # two windows behind the bucket's end
        users = [int(u) if u else None for u in (p.split("|")[0] for p in batch["payment"].tolist())]  # not a column of numbers, which one null among them would round
        yield pd.DataFrame({"id": batch["id"], "user_id": pd.array(users, dtype="Int64"), "match_id": pd.array(out, dtype="Int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.removeKey((expiredTimerInfo.getExpiryTimeInMs() // WIDE_MS - 3,))
        yield pd.DataFrame({"id": [], "user_id": [], "match_id": []})

    def close(self) -> None:
        pass


def stream_near_dup(captures: DataFrame, watermark: str = WATERMARK, tight_ms: int = TIGHT_MS, shards: int = SHARDS) -> DataFrame:
    """(id, user_id, match_id) of a stream's parsed payments: the payment accepted before it that time and merchant take for the same one, or null.

    Only payments of one user, amount and direction meet. They are kept as state, the earliest posted first in a batch, and forgotten when the watermark has left them two windows
    behind. The state lies by shards of users, whose number stays the same for a stream's life. References match at any distance in time, so they need the ledger, as in `stream_ingest`, not bounded state. Needs the RocksDB state store (`with_rocksdb`).
    """
    parsed = parse_captures(captures).withColumn("posted_at", F.timestamp_millis("posted_at_ms")).withWatermark("posted_at", watermark)
    payment = F.concat_ws("|", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "amount_paise", "direction").alias("payment")
    shard = F.pmod(F.xxhash64("user_id"), F.lit(shards)).alias("shard")
    rows = parsed.select("id", shard, payment, "posted_at", "posted_at_ms", F.col("occurred_at_ms").alias("ms"), merchant_identity(F.col("merchant"), 1).alias("m"), capture_origin(F.col("source"), F.col("sender")).alias("origin"))
    return rows.groupBy("shard").transformWithStateInPandas(NearDup(tight_ms), "id long, user_id long, match_id long", "Append", "EventTime")


@contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: a map's entries are read and written one by one, and spill to disk."""
    name, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def pending_sums(spark: SparkSession, path: str) -> DeltaSums:
    return DeltaSums(spark, path, {"user_id": "long"})


def stream_pending_count(changes: DataFrame, sums: DeltaSums, checkpoint: str) -> StreamingQuery:
    """Follow ledger changes (rows with `sign`, as `sums.signed` gives them): the number of rows per user that wait for review. A row that is confirmed or deleted leaves the count."""
    return follow(changes.filter("status = 'pending'"), sums, checkpoint)


def total_sums(spark: SparkSession, path: str) -> DeltaSums:
    return DeltaSums(spark, path, {"user_id": "long", "direction": "string", "start_ms": "long"}, {"total_paise": "long"})


def stream_totals(captures: DataFrame, sums: DeltaSums, checkpoint: str, width_ms: int = DAY_MS) -> StreamingQuery:
    """Follow messages: tumbling totals of their payments, per user and direction. Late messages count where they belong."""
    start = F.floor(F.col("occurred_at_ms") / width_ms) * width_ms
    return follow(parse_captures(captures).select("user_id", "direction", start.cast("long").alias("start_ms"), "amount_paise").withColumnRenamed("amount_paise", "total_paise").withColumn("sign", F.lit(1)), sums, checkpoint)
