"""The ledger on disk: copy-on-write partitions under a manifest.

Rows lie by user bucket and month. A change rewrites the partitions that it touches into a folder of its own and then makes a manifest that names the new folder for these and the old ones for all others.
Readers take the partitions that a manifest names, so they see a change whole or not at all, and every version stays readable until it is vacuumed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import day_of
from ..sources.manifest import Manifest
from ..sources.shared import written
from .ledger import upsert

BUCKETS = 64
PLACE = ["user_bucket", "month"]
NO_MONTH = "none"


class LedgerStore:
    """A ledger with at least user_id, id, dedup_key and occurred_at_ms. One writer at a time; of two, the later one fails and changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), Manifest(spark, path)
        said = self.manifest.latest()[1]
        self.buckets = said.get("buckets", buckets)

    def bucket(self, user: str = "user_id") -> Column:
        return F.pmod(F.xxhash64(user), F.lit(self.buckets)).cast("int").alias("user_bucket")

    @staticmethod
    def month() -> Column:
        return F.coalesce(F.date_format(day_of(F.col("occurred_at_ms")), "yyyy-MM"), F.lit(NO_MONTH)).alias("month")

    def version(self) -> int:
        return self.manifest.latest()[0]

    def parts(self, version: int | None = None) -> dict[tuple[int, str], str]:
        """(user bucket, month) to the folder that holds it."""
        said = self.manifest.latest()[1] if version is None else self.manifest.read(version)
        return {(int(b), m): f for f, held in said.get("parts", {}).items() for b, m in held}

    def _schema(self, version: int | None = None) -> StructType:
        said = self.manifest.latest()[1] if version is None else self.manifest.read(version)
        return StructType.fromJson(said["schema"])

    def _read(self, parts: dict[tuple[int, str], str], schema: StructType) -> DataFrame:
        """The named partitions as one scan, with their places; nothing else is listed or opened, however many versions they are of."""
        paths = [f"{self.path}/data/{f}/user_bucket={b}/month={m}" for (b, m), f in sorted(parts.items())]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.withColumn("user_bucket", self.bucket()).withColumn("month", self.month())

    def read(self, version: int | None = None, users: list[int] | None = None, months: list[str] | None = None) -> DataFrame:
        """The ledger of a version, the latest if none is named; `users` and `months` leave out the partitions that can't hold them."""
        parts = self.parts(version)
        if users is not None:
            wanted = {r[0] for r in self.spark.createDataFrame([(u,) for u in users], "user_id long").select(self.bucket()).distinct().collect()}
            parts = {k: f for k, f in parts.items() if k[0] in wanted}
        if months is not None:
            parts = {k: f for k, f in parts.items() if k[1] in set(months)}
        rows = self._read(parts, self._schema(version)).drop(*PLACE)
        return rows if users is None else rows.filter(F.col("user_id").isin(users))

    def _written(self, rows: DataFrame) -> tuple[str, list[tuple[int, str]]]:
        """A new folder with the rows by place, and the places it has. A place with very many rows is split over tasks."""
        folder = uuid.uuid4().hex
        placed = rows.withColumn("user_bucket", self.bucket()).withColumn("month", self.month())
        placed.hint("rebalance", *map(F.col, PLACE)).write.partitionBy(*PLACE).parquet(f"{self.path}/data/{folder}")
        names = self.manifest.files.names(f"{self.path}/data/{folder}/user_bucket=*/month=*")
        return folder, [(int(n.split("user_bucket=")[1].split("/")[0]), n.rsplit("month=", 1)[1]) for n in names]

    def _commit(self, parts: dict[tuple[int, str], str], schema: StructType, after: int) -> int:
        by_folder: dict[str, list] = {}
        for place, folder in sorted(parts.items()):
            by_folder.setdefault(folder, []).append(place)
        return self.manifest.commit({"buckets": self.buckets, "schema": schema.jsonValue(), "parts": by_folder}, after)

    def write(self, ledger: DataFrame) -> int:
        """The whole ledger as the next version."""
        after = self.version()
        folder, places = self._written(ledger)
        return self._commit({p: folder for p in places}, ledger.schema, after)

    def upsert(self, inserts: DataFrame, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """The next version after `operators.ledger.upsert`, rewriting only what it touches.

        Only the user buckets of the changed users are looked into: by key for inserts, by id for updates and deletes. Touched are the partitions of rows that go or change, and those of rows that come.
        """
        after, (parts, schema) = self.version(), (self.parts(), self._schema())
        changes = [c for c in (inserts, updates, deletes) if c is not None]
        users = changes[0].select("user_id")
        for c in changes[1:]:
            users = users.union(c.select("user_id"))
        buckets = {r[0] for r in users.select(self.bucket()).distinct().collect()}  # as many as there are buckets, at most
        held = self._read({k: f for k, f in parts.items() if k[0] in buckets}, schema)
        names = self.spark.createDataFrame([], "user_id long, id long")
        for c in (updates, deletes):
            names = names if c is None else names.union(c.select("user_id", "id"))
        hit = held.join(names.distinct(), ["user_id", "id"], "left_semi")
        keys = held if deletes is None else held.join(deletes.select("user_id", "id"), ["user_id", "id"], "left_anti")
        fresh = written(inserts.join(keys.select("user_id", "dedup_key"), ["user_id", "dedup_key"], "left_anti").select(*[c for c in schema.names if c in inserts.columns]), "fresh")
        at = fresh.select(self.bucket(), self.month() if "occurred_at_ms" in fresh.columns else F.lit(NO_MONTH).alias("month")).union(hit.select(*PLACE))
        if updates is not None and "occurred_at_ms" in updates.columns:  # rows that move to another month
            at = at.union(updates.join(held.select("user_id", "id"), ["user_id", "id"], "left_semi").select(self.bucket(), self.month()))
        touched = {(r["user_bucket"], r["month"]) for r in at.distinct().collect()}
        old = self._read({k: f for k, f in parts.items() if k in touched}, schema).drop(*PLACE)
        folder, places = self._written(upsert(old, fresh, updates, deletes))
        return self._commit({k: f for k, f in parts.items() if k not in touched} | {p: folder for p in places}, schema, after)

    def vacuum(self, keep: int = 10) -> int:
        """Delete what only versions before the last `keep` name, and what no version names; gives the number of folders deleted."""
        versions = sorted(self.manifest.versions())
        for v in versions[:-keep]:
            self.manifest.drop(v)
        named = {f for v in versions[-keep:] for f in self.manifest.read(v)["parts"]}
        stale = [n for n in self.manifest.files.names(f"{self.path}/data/*") if n.rsplit("/", 1)[1] not in named]
        for n in stale:
            self.manifest.files.delete(n)
        return len(stale)
