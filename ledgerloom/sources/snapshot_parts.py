"""Snapshots of users of any size: documents of bounded size under a manifest.

A user's table is cut into parts by the hash of its rows, as many as its bytes ask for, so no task gathers more than a part. Rows cross the network once, with what all of their user's table's rows
come to, and a table of more than `TASK_PARTS` parts is dealt over several tasks. A manifest, a row per user, says which parts there are, with rows and checksum of each. A
restore takes a user whole or not at all: it refuses a foreign format, a newer schema, a part that is missing, changed or not named, and rows whose parents are not there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import exchanged, passing, written
from .snapshots import FORMAT, SCHEMA_VERSION, TABLES, VERSION

PART_BYTES = 8 << 20
#: Parts that one task makes of a user's table at most.
TASK_PARTS = 64
#: Rows and documents are much text of few words, and on disk all at once.
CODEC = "zstd"
#: (child, column, parent): what a child's column names, if it isn't null, is an id of the parent.
PARENTS = (("transactions", "account_id", "accounts"), ("splits", "transaction_id", "transactions"), ("splits", "person_id", "people"))


def _checksum(document: Column) -> Column:
    return F.sha2(document.cast("binary"), 256)


def _documents(held: DataFrame, sizes: DataFrame, large: DataFrame) -> DataFrame:
    """(user_id, table, part, rows, document) of the rows (user_id, table, row), which are exchanged once: users are keys as structs, equal where both hold null, so the join deals rows by the very columns that they are grouped by."""
    keyed = lambda df: df.withColumn("user", F.struct("user_id")).drop("user_id")
    place = F.pmod(F.xxhash64("row"), F.col("n")).cast("int")
    of_task = F.coalesce(F.floor(place / TASK_PARTS).cast("int"), F.lit(0))
    rows = keyed(held).join(keyed(large), ["user", "table"], "left").select("user", "table", of_task.alias("task"), "row")
    tasks = keyed(sizes).withColumn("task", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / TASK_PARTS).cast("int"))))
    dealt = rows.join(tasks.hint("merge"), ["user", "table", "task"]).select("user", "table", "task", place.alias("part"), "row")
    made = dealt.groupBy("user", "table", "task", "part").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("row")).alias("all"))
    return made.select("user.user_id", "table", "part", "rows", F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("document"))


def export_parts(tables: dict[str, DataFrame], exported_at: str, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """(user_id, table, part, document), a document being a JSON array of rows in order, and the manifests (user_id, format, version, schemaVersion, exportedAt, parts)."""
    rows = None
    for name in TABLES:
        kept = [c for c in tables[name].columns if c != "user_id"]
        one = tables[name].select("user_id", F.lit(name).alias("table"), F.to_json(F.struct(*kept)).alias("row"))
        rows = one if rows is None else rows.union(one)
    with passing(rows, "snapshot-rows", CODEC) as held:
        sizes = written(held.groupBy("user_id", "table").agg(F.ceil(F.sum(F.octet_length("row") + 1) / part_bytes).cast("int").alias("n")), "snapshot-sizes")
        large = written(sizes.filter(F.col("n") > TASK_PARTS), "snapshot-large")  # a row for so many parts' bytes
        parts = written(_documents(held, sizes, large), "snapshot-parts", CODEC)
    said = F.array_sort(F.collect_list(F.struct("table", "part", "rows", _checksum(F.col("document")).alias("checksum"))))
    head = [F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(SCHEMA_VERSION).alias("schemaVersion"), F.lit(exported_at).alias("exportedAt")]
    return parts.select("user_id", "table", "part", "document"), parts.groupBy("user_id").agg(said.alias("parts")).select("user_id", *head, "parts")


def refused_users(parts: DataFrame, manifests: DataFrame, formats: tuple[str, ...] = (FORMAT,)) -> DataFrame:
    """(user_id, reason) of the users that can't be restored for what their manifest and parts are."""
    head = F.when(~F.coalesce("format", F.lit("")).isin(*formats), "foreign format").when(F.col("schemaVersion") > SCHEMA_VERSION, "newer schema")
    judged = manifests.select("user_id", head.alias("reason"))
    named = manifests.select("user_id", F.explode("parts").alias("p")).select("user_id", "p.table", "p.part", "p.checksum")
    found = parts.select("user_id", "table", "part", _checksum(F.col("document")).alias("found"))
    same = F.col("n.user_id").eqNullSafe(F.col("f.user_id")) & (F.col("n.table") == F.col("f.table")) & (F.col("n.part") == F.col("f.part"))
    both = named.alias("n").join(found.alias("f"), same, "full").select(F.when(F.col("n.table").isNotNull(), F.col("n.user_id")).otherwise(F.col("f.user_id")).alias("user_id"), "checksum", "found")
    why = F.when(F.col("found").isNull(), "missing part").when(F.col("checksum").isNull(), "unknown part").when(F.col("found") != F.col("checksum"), "changed part")
    every = judged.union(both.select("user_id", why.alias("reason"))).filter("reason is not null")
    rank = F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(("foreign format", "newer schema", "missing part", "unknown part", "changed part")) for x in (r, i)]), F.col("reason"))
    return every.groupBy("user_id").agg(F.min_by("reason", rank).alias("reason"))


def restore_parts(parts: DataFrame, manifests: DataFrame, schemas: dict[str, str], formats: tuple[str, ...] = (FORMAT,)) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table's rows with user_id, and (user_id, reason) of the users refused. `schemas` are the tables' columns, `user_id` left out; parents come before children."""
    bad = written(refused_users(parts, manifests, formats), "refused")
    without = lambda df, gone: df.join(gone.select(F.col("user_id").alias("__u")), F.col("user_id").eqNullSafe(F.col("__u")), "left_anti")
    good, rows = without(parts, bad), {}
    for name in TABLES:
        if name in schemas:
            parsed = good.filter(F.col("table") == name).select("user_id", F.from_json("document", f"array<struct<{schemas[name]}>>").alias("rows"))
            rows[name] = written(parsed.select("user_id", F.inline("rows")), "restored-rows")  # as a parent, as a child and as a result: a document is parsed once
    orphans = None
    for child, column, parent in PARENTS:
        if child in rows and parent in rows and column in rows[child].columns:
            # a document's rows name a parent many times; what is left is dealt as the join needs it
            held = rows[parent].select(F.struct("user_id").alias("__u"), F.col("id").alias("__id"))
            named = rows[child].filter(F.col(column).isNotNull()).select(F.struct("user_id").alias("__u"), F.col(column).alias("__id")).distinct()
            lost = named.join(exchanged(held), ["__u", "__id"], "left_anti").select("__u.user_id")
            orphans = lost if orphans is None else orphans.union(lost)
    if orphans is None:
        return rows, bad
    orphans = written(orphans.distinct().withColumn("reason", F.lit("rows without parents")), "orphans")
    return {name: without(df, orphans) for name, df in rows.items()}, bad.union(orphans)
