"""Sums that follow changes, bitmaps of consumed ids, and settled times, against recomputation."""

import random
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.operators import ledger
from ledgerloom.operators import splits as sp
from ledgerloom.sources import captures
from ledgerloom.streaming import ingest, sums

ROWS = "user_id long, id long, status string"


def test_sums_follow_inserts_changes_and_deletes(spark, tmp_path):
    """Five batches of changes, merged twice, each sent again: the counts are those of the table as it is."""
    rng, table = random.Random(1), {}
    counts = ingest.pending_sums(spark, str(tmp_path / "s"))
    counts.fanout = 2
    for batch in range(5):
        before, after = [], []
        for i in rng.sample(range(40), 15):
            old = table.get(i)
            new = None if old and rng.random() < 0.3 else (i % 4, i, rng.choice(["pending", "confirmed"]))
            before += [old] if old else []
            after += [new] if new else []
            table[i] = new
        changes = sums.signed(spark.createDataFrame(before, ROWS), spark.createDataFrame(after, ROWS)).filter("status = 'pending'")
        counts.add(changes, batch)
        counts.add(changes, batch)
        want = Counter(r[0] for r in table.values() if r and r[2] == "pending")
        assert {r["user_id"]: r["n"] for r in counts.read().collect()} == dict(want)
    assert counts.last_batch() == 4 and sum(map(len, counts.said()["levels"])) <= 3
    gone = spark.createDataFrame([r for r in table.values() if r], ROWS).filter("status = 'pending'")
    counts.add(sums.signed(gone, gone.limit(0)))
    assert counts.read().count() == 0
    again = ingest.pending_sums(spark, str(tmp_path / "s"))
    assert again.last_batch() == 4 and again.read().count() == 0  # opened anew


def test_confirming_lowers_the_count(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "pending"), (1, 2, "pending"), (2, 3, "pending")], ROWS)
    counts = ingest.pending_sums(spark, str(tmp_path / "s"))
    told = lambda: {r["user_id"]: r["n"] for r in counts.read().collect()}
    counts.add(sums.signed(rows.limit(0), rows), 0)
    assert told() == {1: 2, 2: 1}
    one = rows.filter("id = 2")
    counts.add(sums.signed(one, one.withColumn("status", F.lit("confirmed"))).filter("status = 'pending'"), 1)
    assert told() == {1: 1, 2: 1}


def test_bitmaps_equal_id_lists(spark):
    rng = random.Random(2)
    ids = [0, 1, 2, 32_768, 32_769, 65_536, 65_537, 2**40, 2**40 + 1] + [rng.randrange(1, 200_000) for _ in range(300)]
    rows = spark.createDataFrame([(u, i, (u or 1) * i) for u in (1, 2, None) for i in set(ids)], "user_id long, id long, posted_at_ms long")
    done = rows.filter("user_id is not null and (id + user_id) % 3 = 0")
    bits = captures.consumed_bitmaps(done)
    told = lambda df: sorted(map(tuple, df.select("user_id", "id").collect()), key=repr)
    assert told(captures.drain_pending(rows, bits, 50)) == told(captures.drain_pending(rows, done, 50))
    drained = captures.drain_pending(rows, bits, 50).filter("user_id is not null and id > 0")
    marked = captures.mark_consumed(bits, drained)
    assert marked.count() == captures.mark_consumed(marked, drained).count()
    assert told(captures.consumed_ids(marked).filter("id > 0")) == told(captures.mark_consumed(done, drained).filter("id > 0"))
    assert captures.consumed_bitmaps(done.limit(0)).count() == 0


def test_bitmaps_are_as_small_as_what_they_hold(spark):
    """Ids far apart cost some bytes each, not a whole range's bitmap, which a task that sorts thousands of them would hold."""
    rows = spark.range(2_000).selectExpr("id % 40 as user_id", "id * 40000 + 1 as id")
    bits = captures.consumed_bitmaps(rows)
    held = bits.select(F.sum(F.length(F.to_json(F.struct("bits")))).alias("n"), F.count("*").alias("ranges")).first()
    assert held["ranges"] == 2_000 and held["n"] < 2_000 * 100
    full = captures.consumed_bitmaps(spark.range(1, 32_769).selectExpr("1L as user_id", "id"))
    assert [r["n"] for r in captures.consumed_ids(full).agg(F.countDistinct("id").alias("n")).collect()] == [32_768] and full.count() == 1


def test_settled_times_stay(spark):
    schema = "user_id long, transaction_id long, person_id long, amount_paise long, direction string, settled_at_ms long"
    held = spark.createDataFrame([(1, 1, 7, 100, "owed_to_me", 5), (1, 1, 8, 100, "owed_to_me", None), (1, 2, 7, 50, "i_owe", None)], schema)
    new = spark.createDataFrame([(1, 1, 7, "owed_to_me", 60), (1, 1, 7, "i_owe", 10), (1, 1, 9, "owed_to_me", 0)], "user_id long, transaction_id long, person_id long, direction string, amount_paise long")
    out = sp.replace_splits(held, new)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(1, 1, 7, 60, "owed_to_me", 5), (1, 1, 7, 10, "i_owe", None), (1, 2, 7, 50, "i_owe", None)], key=repr)
    done = sp.settle_up(out, out.filter("person_id = 7"), 99)
    assert sorted(r["settled_at_ms"] for r in done.collect()) == [5, 99, 99]


def test_search_takes_text_as_it_is(spark):
    rows = spark.createDataFrame([(1, "a\\b"), (2, "A\\B x"), (3, "ab"), (4, "Élan"), (5, "élan"), (6, "a\\")], "id long, title string").withColumn("status", F.lit("confirmed")).withColumn("occurred_at_ms", F.lit(0))
    found = lambda text: sorted(r["id"] for r in ledger.history_filter(rows, text).collect())
    assert found("a\\b") == [1, 2] and found("élan") == [5] and found("\\") == [1, 2, 6] and found("A%") == [1, 2, 3, 4, 5, 6] and found("a_b") == [1, 2]
