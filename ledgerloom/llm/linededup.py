"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A run is a table of line keys, bucketed and sorted by hash: (h1, h2, n_docs, last_doc). Each batch of documents is merge-anti-joined with all
runs: keys that no run has become a run of their own, the counts of the others are updates. When a level holds `fanout` runs they are merged into one run
of the next level. What is dropped depends on a key's counts, which are those of its run and its updates.

Edge cases: a null or empty text is one empty line and keeps the hash of the empty string; keys shorter than the limit are
never dropped; a document's repeated lines count its id once; rows that repeat a doc_id count as one document; a null doc_id
is one document, smaller than all others; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Scratch, cut, written

MIN_CHARS = 40
MIN_DOCS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "h1 long, h2 long, n_docs long, last_doc long"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineRuns:
    """Levels of sorted runs in the shared folder: every key is in one run, with the counts of the batch that brought it; later counts are updates.

    Runs are tables bucketed by key, so a batch crosses the network once and meets them all by merge joins, while the runs stay where they are.
    Every run is a written table, so a lost executor costs a re-read.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout = spark, fanout
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.scratch = Scratch(spark)
        self.root = self.scratch.path("line-runs")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.updates: list[str] = []
        self.made = 0

    def _write(self, df: DataFrame) -> str:
        self.made += 1
        table = f"{self.name}_{self.made}"
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{self.made}").saveAsTable(table)
        return table

    def _add_run(self, df: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self._write(df))
        return self.levels[level][-1]

    def rows(self, tables: list[str]) -> DataFrame:
        """Runs together, as plain files: Spark 4.1 takes a union of bucketed tables for partitioned by key and then sums wrongly."""
        return self.spark.read.schema(RUN).parquet(*[f"{self.root}/{t.rsplit('_', 1)[1]}" for t in tables])

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch of (h1, h2, n_docs, last_doc), a row per key. The keys that no run has are written as a run and returned; the others are updates."""
        batch = batch.repartition(self.buckets, "h1", "h2")
        fresh, known = batch, bool(self.runs())
        for run in self.runs():
            fresh = fresh.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
        added = self._add_run(fresh, 0)
        out = self.spark.table(added)
        if known:
            self.updates.append(self._write(batch.join(out.select("h1", "h2"), ["h1", "h2"], "left_anti")))
        self.compact()
        return out

    def compact(self) -> None:
        """Full levels become one run of the next level; their keys differ, so nothing is summed. Updates are summed when there are `fanout` of them."""
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                merged, self.levels[level] = self.levels[level], []
                self._add_run(self.rows(merged).repartition(self.buckets, "h1", "h2"), level + 1)
            level += 1
        if len(self.updates) >= self.fanout:
            self.updates = [self._write(merged_keys(self.rows(self.updates)))]

    def repeated(self, min_docs: int) -> DataFrame:
        """Keys found in `min_docs` documents or more, over all runs and updates."""
        found = self.rows(self.runs())
        if self.updates:
            more = merged_keys(self.rows(self.updates)).select("h1", "h2", F.col("n_docs").alias("more"), F.col("last_doc").alias("later"))
            n, last = F.col("n_docs") + F.coalesce("more", F.lit(0)), F.greatest("last_doc", "later")
            found = found.join(more, ["h1", "h2"], "left").select("h1", "h2", n.alias("n_docs"), last.alias("last_doc"))
        return found.filter(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Delete the runs; what was read from them must have been written by then."""
        for i in range(1, self.made + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")
        self.scratch.clear()


def merged_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))


def line_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int, batches: int) -> DataFrame:
    """(batch, id, th, pos, h1, h2) of the lines long enough; two 64-bit hashes stand for a key, `th` tells rows of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    keyed = lines.select("id", "th", "pos", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    batch = F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int")
    return keyed.select(batch.alias("batch"), "id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_positions(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(id, th, drops): the sorted positions of the lines each row loses; rows that lose none are left out."""
    spark = docs.sparkSession
    lines = written(line_rows(docs, id_col, text_col, min_chars, batches), "lines")
    # a row per (key, document) first: a key in a third of all documents is spread over their ids, and met by partial counts
    per_doc = lines.select("batch", "h1", "h2", "id").distinct()
    index = LineRuns(spark, fanout)
    staged = index.scratch.written(per_doc.groupBy("batch", "h1", "h2").agg(F.count("*").alias("n_docs"), F.max("id").cast("long").alias("last_doc")), "line-batches", "batch")
    try:
        for b in range(batches):
            index.add(staged.filter(F.col("batch") == b).drop("batch"))
        # written, so that both sides of the join are plain exchanges and a hot line's rows can be dealt to several tasks
        repeated = cut(index.repeated(min_docs))
    finally:
        index.close()
    hits = lines.join(repeated, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last_doc")))
    return hits.groupBy("id", "th").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def without_positions(lines: Column, drops: Column) -> Column:
    """The lines but for the sorted positions: the slices between them, so the work is linear in the lines."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda p: p + 1))
    ends = F.concat(drops, F.array(F.size(lines)))
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice(lines, s + 1, e - s)))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """`docs` with `n_lines`, `n_dropped` and `kept_text` added. The texts cross the network once, in the last join."""
    drops = dropped_positions(docs, id_col, text_col, min_chars, min_docs, batches, fanout).select(
        F.col("id").alias("__id"), F.col("th").alias("__th"), F.col("drops").alias("__drops")
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = docs.join(drops, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    lines = F.split(text, "\n")
    kept = F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(without_positions(lines, F.col("__drops")), "\n"))
    return joined.select(
        *[docs[c] for c in docs.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__drops"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )
