"""A standing index of the ledger for live matching: what a batch of messages is held against, kept up to date batch by batch.

Three tables stand for the ledger: its keys, its references by either end, and its payments by 12-hour bucket. Each row has one 64-bit key, by which its table is bucketed and sorted, so a batch meets the
index where it lies: the batch is exchanged, the index never is. The rows that share a key with the batch come out (a semi-join), and only these go on to the exact tests.

Tables are levelled runs. A batch adds a run; `fanout` runs of a level are merged into one of the next, so there are few runs and a row is rewritten once a level. What the index consists of is a
manifest: a run that no manifest names is not there, and a batch that is replayed is known by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import TIGHT_MS, WIDE_MS, references_match
from ..operators.dedup import GROUP, _incoming_times, _ledger_times, _reference_keys, best_match, nearest
from ..sources.manifest import Manifest
from ..sources.shared import written

BUCKETS, FANOUT = 64, 4
#: Keys of a batch up to this many are named to the scan, which then opens only their buckets.
NAMED_KEYS = 2_000

SCHEMAS = {
    "keys": "k long, user_id long, dedup_key string",
    "refs": "k long, user_id long, amount_paise long, direction string, key6 string, ledger_id long, led_ref string",
    "times": "k long, user_id long, amount_paise long, direction string, ledger_id long, led_ms long, led_merchant string, led_origin string, led_ref string",
    "gone": "k long, user_id long, ledger_id long",
}


def _bucket_of(ms: Column) -> Column:
    return F.floor(ms / WIDE_MS).cast("long")


class MatchIndex:
    """Kept under `path`, which driver and executors share. Reading and adding are one writer's."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, fanout: int = FANOUT):
        self.spark, self.path, self.fanout, self.manifest = spark, path.rstrip("/"), fanout, Manifest(spark, path)
        self.buckets = self.manifest.latest()[1].get("buckets", buckets)

    def said(self) -> dict:
        return {"buckets": self.buckets, "batch": -1, "runs": {k: [] for k in SCHEMAS}} | self.manifest.latest()[1]

    def last_batch(self) -> int:
        return self.said()["batch"]

    def runs(self, kind: str) -> list[str]:
        return [r for level in self.said()["runs"][kind] for r in level]

    def _write(self, rows: DataFrame, kind: str) -> str:
        run = f"{kind}_{uuid.uuid4().hex}"
        named = rows.select(*[c.split(" ")[0] for c in SCHEMAS[kind].split(", ")])
        dealt = named.repartition(self.buckets, "k").sortWithinPartitions("k")
        dealt.write.option("path", f"{self.path}/{run}").bucketBy(self.buckets, "k").sortBy("k").saveAsTable(run)
        return run

    def _table(self, run: str) -> DataFrame:
        """A run as a bucketed table; one that another session wrote is made known to this one."""
        kind = run.split("_")[0]
        if not self.spark.catalog.tableExists(run):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run} ({SCHEMAS[kind].replace(' long', ' BIGINT')}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{run}'")
        return self.spark.table(run)

    def add(self, ledger: DataFrame, batch: int | None = None) -> None:
        """Add ledger rows, of a stream's batch if one is named; a batch that the index has is left alone."""
        said, after = self.said(), self.manifest.latest()[0]
        if batch is not None and batch <= said["batch"]:
            return
        ledger = written(ledger, "index-rows")
        times = written(_ledger_times(ledger), "index-times")
        refs = _reference_keys(times, "led")
        new = {
            "keys": ledger.filter("dedup_key is not null").select(F.xxhash64("user_id", "dedup_key").alias("k"), "user_id", "dedup_key"),
            "refs": refs.select(F.xxhash64(*GROUP, "key6").alias("k"), *GROUP, "key6", "ledger_id", "led_ref"),
            "times": times.withColumn("k", F.xxhash64(*GROUP, _bucket_of(F.col("led_ms")))),
        }
        self._commit(said, {k: self._write(rows, k) for k, rows in new.items()}, batch, after)

    def remove(self, rows: DataFrame) -> None:
        """Ledger rows (user_id, id) that are no more: they match nothing from now on. Their keys stay held."""
        said, after = self.said(), self.manifest.latest()[0]
        gone = rows.select(F.xxhash64("user_id", "id").alias("k"), "user_id", F.col("id").alias("ledger_id"))
        self._commit(said, {"gone": self._write(gone, "gone")}, None, after)

    def _commit(self, said: dict, new: dict[str, str], batch: int | None, after: int) -> None:
        """Name the new runs, merging full levels first; then forget the merged ones."""
        stale = []
        for kind, run in new.items():
            levels = said["runs"][kind]
            for level in range(len(levels) + 1):
                if level == len(levels):
                    levels.append([])
                levels[level].append(run)
                if len(levels[level]) < self.fanout:
                    break
                merged, levels[level] = levels[level], []
                run = self._write(self.spark.read.schema(SCHEMAS[kind]).parquet(*[f"{self.path}/{r}" for r in merged]), kind)
                stale += merged
        self.manifest.commit(said | {"batch": said["batch"] if batch is None else batch}, after)
        for r in stale:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
            self.manifest.files.delete(f"{self.path}/{r}")

    def close(self) -> None:
        """Take the tables' names out of the session's catalog; the index stays where it is."""
        for kind in SCHEMAS:
            for run in self.runs(kind):
                self.spark.sql(f"DROP TABLE IF EXISTS {run}")

    def _met(self, kind: str, keys: DataFrame) -> DataFrame:
        """The index rows of a kind whose key is among `keys` (k)."""
        keys = written(keys.select("k").distinct(), "batch-keys")
        few = [r["k"] for r in keys.limit(NAMED_KEYS + 1).collect()]
        out = self.spark.createDataFrame([], SCHEMAS[kind])
        for run in self.runs(kind):
            rows = self._table(run)
            out = out.union((rows.filter(F.col("k").isin(few)) if len(few) <= NAMED_KEYS else rows).join(keys, "k", "left_semi"))
        return out

    def held_keys(self, incoming: DataFrame) -> DataFrame:
        """(user_id, dedup_key) of the index that the incoming rows may have."""
        return self._met("keys", incoming.select(F.xxhash64("user_id", "dedup_key").alias("k"))).select("user_id", "dedup_key")

    def _there(self, rows: DataFrame) -> DataFrame:
        if not self.runs("gone"):
            return rows
        return rows.join(self._met("gone", rows.select(F.xxhash64("user_id", "ledger_id").alias("k"))).select("user_id", "ledger_id"), ["user_id", "ledger_id"], "left_anti")

    def find_duplicate(self, incoming: DataFrame, tight_ms: Column | int = TIGHT_MS) -> DataFrame:
        """`operators.dedup.find_duplicate` against the rows in the index."""
        left = written(_incoming_times(incoming, tight_ms), "incoming")
        ends = _reference_keys(left, "in")
        refs = written(self._there(self._met("refs", ends.select(F.xxhash64(*GROUP, "key6").alias("k")))).drop("k"), "met-references")
        pairs = ends.join(refs, [*GROUP, "key6"]).filter(references_match(F.col("in_ref"), F.col("led_ref")))
        reach = F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.xxhash64(*GROUP, _bucket_of(F.col("in_ms")) + d))).alias("k")
        times = written(self._there(self._met("times", left.select(reach))).drop("k"), "met-times")
        return best_match(pairs, nearest(left, times))
