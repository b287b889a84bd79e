"""Snapshots in parts: round trips, bounded parts, and what is refused."""

import os

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import ledger_queries
from ledgerloom.sources import snapshot_parts, snapshots

SHAPES = {"accounts": "id: long", "categories": "id: long", "people": "id: long", "transactions": "id: long, account_id: long, note: string", "category_rules": "id: long", "splits": "id: long, transaction_id: long, person_id: long"}


def tables_of(spark, n):
    """One user with n payments and another with a few; a null user too."""
    ids = spark.range(n).select(F.lit(1).cast("long").alias("user_id"), "id").union(spark.createDataFrame([(2, 0), (2, 1), (None, 0)], "user_id long, id long"))
    few = ids.filter("id < 2")
    return {
        "accounts": few, "categories": few, "people": few, "category_rules": few.limit(0), "transactions": ids.select("user_id", "id", F.when(F.col("id") % 3 == 0, 0).cast("long").alias("account_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit('ü "quote",\\n'), "id")).alias("note")),
        "splits": few.select("user_id", "id", F.col("id").alias("transaction_id"), F.lit(0).cast("long").alias("person_id")),
    }


def test_parts_round_trip_and_are_bounded(spark):
    tables = tables_of(spark, 20_000)
    parts, manifests = snapshot_parts.export_parts(tables, "now", 20_000)
    sizes = parts.filter("table = 'transactions' and user_id = 1").select(F.length("document")).collect()
    assert len(sizes) > 30 and max(s[0] for s in sizes) < 40_000
    rows, refused = snapshot_parts.restore_parts(parts, manifests, SHAPES)
    assert refused.count() == 0
    for name in snapshots.TABLES:
        want = tables[name]
        assert rows[name].select(*want.columns).exceptAll(want).count() == 0 == want.exceptAll(rows[name].select(*want.columns)).count()


@pytest.mark.parametrize("what,reason", [("lost", "missing part"), ("changed", "changed part"), ("more", "unknown part"), ("schema", "newer schema"), ("format", "foreign format"), ("parent", "rows without parents")])
def test_a_user_is_restored_whole_or_not_at_all(spark, what, reason):
    tables = tables_of(spark, 300)
    if what == "parent":
        tables["accounts"] = tables["accounts"].filter("user_id is null or user_id != 1")
    parts, manifests = snapshot_parts.export_parts(tables, "now", 2_000)
    hit = (F.col("user_id") == 1) & (F.col("table") == "transactions") & (F.col("part") == 1)
    if what == "lost":
        parts = parts.filter(~F.coalesce(hit, F.lit(False)))
    elif what == "changed":
        parts = parts.withColumn("document", F.when(hit, "[]").otherwise(F.col("document")))
    elif what == "more":
        parts = parts.unionByName(parts.filter(hit).withColumn("part", F.lit(999)))
    elif what == "schema":
        manifests = manifests.withColumn("schemaVersion", F.when(F.col("user_id") == 1, 99).otherwise(F.col("schemaVersion")))
    elif what == "format":
        manifests = manifests.withColumn("format", F.when(F.col("user_id") == 1, "x").otherwise(F.col("format")))
    rows, refused = snapshot_parts.restore_parts(parts, manifests, SHAPES)
    assert [tuple(r) for r in refused.collect()] == [(1, reason)]
    assert {r["user_id"] for r in rows["transactions"].collect()} == {2, None}


def test_documents_are_parsed_once(spark):
    """What is read from a restore doesn't parse the documents again."""
    parts, manifests = snapshot_parts.export_parts(tables_of(spark, 30), "now", 2_000)
    rows, _ = snapshot_parts.restore_parts(parts, manifests, SHAPES)
    assert all("from_json" not in df._jdf.queryExecution().optimizedPlan().toString().lower() for df in rows.values())
    assert rows["transactions"].count() == 33


def test_rows_cross_the_network_once_and_go(spark, monkeypatch):
    """One exchange for the rows and one for the sizes; a large table is dealt over tasks; rows don't stay on disk beside their documents."""
    monkeypatch.setattr(snapshot_parts, "TASK_PARTS", 4)
    made, plain = [], snapshot_parts._documents
    monkeypatch.setattr(snapshot_parts, "_documents", lambda *a: made.append(plain(*a)) or made[-1])
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    tables = tables_of(spark, 4_000)
    parts, manifests = snapshot_parts.export_parts(tables, "now", 5_000)
    new = {x.rpartition("-")[0].rstrip("-0123456789abcdef") for x in set(os.listdir(folder)) - before}
    assert any(x.startswith("snapshot-part") for x in new) and not any(x.startswith("snapshot-row") for x in new)
    plan = made[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2, plan
    assert parts.filter("user_id = 1 and table = 'transactions'").count() > 8
    rows, refused = snapshot_parts.restore_parts(parts, manifests, SHAPES)
    assert refused.count() == 0
    for name in snapshots.TABLES:
        want = tables[name]
        assert rows[name].select(*want.columns).exceptAll(want).count() == 0 == want.exceptAll(rows[name].select(*want.columns)).count()


def test_the_query_exchanges_no_document_that_it_keeps(spark, monkeypatch, sf_dir):
    """Only documents of users and tables that lose a part are joined with what is lost."""
    seen, plain = [], ledger_queries.sparts.restore_parts
    monkeypatch.setattr(ledger_queries.sparts, "restore_parts", lambda parts, *a: seen.append(parts) or plain(parts, *a))
    ledger_queries.snapshot_parts(spark, sf_dir)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Join") == 1, plan
    assert "% 6) = 3" in plan.partition("Join LeftAnti")[2].partition("Relation")[0]
