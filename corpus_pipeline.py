"""A corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the columns of documents; the last returns the packing plan.
Edge cases are those of the operators; texts that lose all their lines stay, empty; rows that repeat both id and text
are one document, and a null text is an empty one there; of each near-duplicate class one row stays, whatever ids and texts repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import dartminhash, linededup, packing, quality, secrets
from ledgerloom.llm.common import scratch_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _resized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs.select(*COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(linededup.dedup_lines(docs.select(*COLUMNS)).withColumn("text", F.col("kept_text")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = dartminhash.near_duplicates(docs).filter("keeps")
    kept = found.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")).distinct()
    # one hash is the key of the join and of the last step, so texts cross the network once; the id and the text's own hash decide
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h")).withColumn("__k", F.xxhash64("doc_id", "__h"))
    same = (F.col("__k") == F.xxhash64("__id", "__th")) & F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    return rows.join(kept, same, "left_semi").dropDuplicates(["__k", "doc_id", "__h"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _resized(secrets.redact(docs))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("packing", pack_batches),
]

#: Near-dedup, decoded secrets and the packing's dynamic programme are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written as Parquet in the shared folder and read back by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
