"""Snapshots: a user's whole ledger as one document, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FORMAT, VERSION, SCHEMA_VERSION, KEEP = "ledger-snapshot", 1, 8, 10
TABLES = ("accounts", "categories", "people", "transactions", "category_rules", "splits")


def snapshot_export(tables: dict[str, DataFrame], exported_at: str) -> DataFrame:
    """(user_id, document): format, version, schemaVersion, exportedAt and an array per table, absent tables empty.

    Each table is gathered per user and the gathered rows meet on user_id; a document holds one user, however many users there are.
    """
    out = None
    for name in TABLES:
        rows = tables[name]
        kept = [c for c in rows.columns if c != "user_id"]
        one = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias(name))
        out = one if out is None else out.join(one, "user_id", "full")
    head = [F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt")]
    arrays = [F.coalesce(F.col(n), F.array().cast(out.schema[n].dataType)).alias(n) for n in TABLES]
    return out.select("user_id", F.to_json(F.struct(*head, *arrays)).alias("document"))


def snapshot_head(documents: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """The documents with `reason`: null if the document can be restored. `formats` are the format names taken for one's own."""
    head = F.from_json("document", "format string, version int, schemaVersion int")
    reason = F.when(~F.coalesce(F.col("h.format"), F.lit("")).isin(*formats), "foreign format").when(F.col("h.schemaVersion") > SCHEMA_VERSION, "newer schema")
    return documents.withColumn("h", head).withColumn("reason", reason).drop("h")


def snapshot_restore(documents: DataFrame, schemas: dict[str, str], formats: tuple[str, ...] = (FORMAT,)) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table's rows with user_id, parents before children, and (user_id, reason) of the documents refused whole."""
    judged = snapshot_head(documents, formats)
    good = judged.filter("reason is null")
    rows = {}
    for name in TABLES:
        if name in schemas:
            parsed = good.select("user_id", F.from_json("document", f"{name} array<struct<{schemas[name]}>>")[name].alias("rows"))
            rows[name] = parsed.select("user_id", F.inline("rows"))
    return rows, judged.filter("reason is not null").select("user_id", "reason")


def snapshot_retain(snapshots: DataFrame, keep: int = KEEP) -> DataFrame:
    """The snapshots (user_id, snapshot_id, modified_ms) to delete: all but each user's newest."""
    order = W.partitionBy("user_id").orderBy(F.desc("modified_ms"), F.desc("snapshot_id"))
    return snapshots.withColumn("row_no", F.row_number().over(order)).filter(F.col("row_no") > keep).drop("row_no")
