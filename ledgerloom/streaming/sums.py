"""Sums by key that follow a stream of changes: what is inserted adds, what goes takes off, and a change does both.

A batch's signed rows are summed by key and stored as a run; the value of a key is the sum over the runs. `fanout` runs of a level are summed into one of the next, where keys whose rows have all gone are
dropped. No operator state is kept, so nothing has to be remembered for late rows nor forgotten behind a watermark, and a batch costs what it holds. A batch that is replayed is known by its number.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.manifest import Manifest

FANOUT = 8


def signed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The change from `before` to `after` of the same rows: each old row with sign -1 and each new one with sign 1; inserts have no row before, deletes none after."""
    return before.withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1)))


class DeltaSums:
    """`keys` and `sums` are name to type; every key also has `n`, the number of its rows. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], sums: dict[str, str] | None = None, fanout: int = FANOUT):
        self.spark, self.path, self.keys, self.sums, self.fanout, self.manifest = spark, path.rstrip("/"), keys, sums or {}, fanout, Manifest(spark, path)
        self.schema = ", ".join(f"{c} {t}" for c, t in {**keys, "n": "long", **self.sums}.items())

    def said(self) -> dict:
        return {"batch": -1, "levels": []} | self.manifest.latest()[1]

    def last_batch(self) -> int:
        return self.said()["batch"]

    def _runs(self, runs: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{r}" for r in runs]) if runs else self.spark.createDataFrame([], self.schema)

    def _summed(self, rows: DataFrame) -> DataFrame:
        out = rows.groupBy(*self.keys).agg(F.sum("n").alias("n"), *[F.sum(c).cast(t).alias(c) for c, t in self.sums.items()])
        return out.filter(" or ".join(f"{c} != 0" for c in ("n", *self.sums)))

    def _write(self, rows: DataFrame) -> str:
        run = f"run-{uuid.uuid4().hex}"
        rows.select(*self.keys, "n", *self.sums).write.parquet(f"{self.path}/{run}")
        return run

    def add(self, rows: DataFrame, batch: int | None = None) -> None:
        """Rows with the keys, the summed columns and `sign`: 1 for a row that comes, -1 for one that goes."""
        said, after = self.said(), self.manifest.latest()[0]
        if batch is not None and batch <= said["batch"]:
            return
        run = self._write(self._summed(rows.select(*self.keys, F.col("sign").cast("long").alias("n"), *[(F.col("sign") * F.col(c)).cast(t).alias(c) for c, t in self.sums.items()])))
        levels, stale = said["levels"], []
        for level in range(len(levels) + 1):
            if level == len(levels):
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < self.fanout:
                break
            merged, levels[level] = levels[level], []
            run = self._write(self._summed(self._runs(merged)))
            stale += merged
        self.manifest.commit({"batch": said["batch"] if batch is None else batch, "levels": levels}, after)
        for r in stale:
            self.manifest.files.delete(f"{self.path}/{r}")

    def read(self) -> DataFrame:
        """The keys that have rows, with `n` and the sums."""
        return self._summed(self._runs([r for level in self.said()["levels"] for r in level])).filter("n != 0")


def follow(changes: DataFrame, sums: DeltaSums, checkpoint: str) -> StreamingQuery:
    """Run a stream of signed rows into the sums."""
    return changes.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda rows, i: sums.add(rows, i)).start()
