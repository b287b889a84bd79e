"""The ledger on disk and the standing index: versions, crashes, what a change rewrites and what a batch exchanges, and equality with the plain operators."""

import os
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.functions import messages
from ledgerloom.operators import dedup, flows, ledger, store
from ledgerloom.plans import views
from ledgerloom.sources import captures, manifest
from ledgerloom.streaming import ingest
from ledgerloom.streaming.index import MatchIndex

from .test_ledger_operators import PAYMENT
from .test_matching import held_of, spread

DAY = 86_400_000
ROWS = "user_id long, id long, category string, dedup_key string, occurred_at_ms long"


def told(df):
    return sorted(map(tuple, df.select("user_id", "id", "category", "dedup_key", "occurred_at_ms").collect()), key=repr)


def test_manifest_is_whole_or_not_there(spark, tmp_path):
    m = manifest.Manifest(spark, str(tmp_path))
    assert m.latest() == (0, {})
    assert m.commit({"a": "ü"}, 0) == 1 and m.commit({"a": 2}, 1) == 2
    assert m.latest() == (2, {"a": 2}) and m.read(1) == {"a": "ü"}
    with pytest.raises(Exception, match="exist"):
        m.commit({"a": 3}, 1)  # somebody else has made version 2
    assert m.latest() == (2, {"a": 2})


@pytest.mark.parametrize("seed", [1])
def test_store_equals_plain_upsert(spark, tmp_path, seed):
    """Random changes in turn, over users, months, null times and moved rows: each version is what the plain operator gives."""
    rng = random.Random(seed)
    at = lambda: rng.choice([None, 5, 40, 41, 75]) and rng.choice([5, 40, 75]) * DAY
    rows = [(rng.randrange(6), i, "c", f"k{i}", at()) for i in range(60)]
    kept = store.LedgerStore(spark, str(tmp_path / "l"), 4)
    kept.write(spark.createDataFrame(rows, ROWS))
    want = {1: sorted(rows, key=repr)}
    for turn in range(2, 5):
        now = kept.read()
        some = rng.sample(told(now), 12)
        new = spark.createDataFrame([(rng.randrange(6), 1000 * turn + i, "new", rng.choice([f"k{rng.randrange(60)}", f"n{turn}{i % 5}"]), at()) for i in range(8)], ROWS)
        changed = spark.createDataFrame([(r[0], r[1], "moved", at()) for r in some[:6]], "user_id long, id long, category string, occurred_at_ms long")
        gone = spark.createDataFrame([r[:2] for r in some[6:]] + [(99, 99)], "user_id long, id long")
        want[turn] = told(ledger.upsert(now, new, changed, gone))
        assert kept.upsert(new, changed, gone) == turn
        assert told(kept.read()) == want[turn]
    assert all(told(kept.read(v)) == w for v, w in want.items())


def test_store_rewrites_what_it_touches(spark, tmp_path):
    rows = [(u, 100 * u + m, "c", f"k{u}-{m}", m * 31 * DAY + DAY) for u in range(12) for m in range(6)]
    kept = store.LedgerStore(spark, str(tmp_path / "l"), 4)
    kept.write(spark.createDataFrame(rows, ROWS))
    first = kept.parts()
    kept.upsert(spark.createDataFrame([], ROWS), spark.createDataFrame([(3, 302, "x")], "user_id long, id long, category string"))
    moved = {k for k, f in kept.parts().items() if first[k] != f}
    assert len(first) > 12 and len(moved) == 1  # one row of one month: one partition
    kept.upsert(spark.createDataFrame([(3, 999, "c", "k3-2", DAY)], ROWS))  # a key that is held: nothing to do
    assert set(kept.parts()) == set(first) and told(kept.read(users=[3], months=["1970-03"])) == [(3, 302, "x", "k3-2", 63 * DAY)]
    gone = spark.createDataFrame([r[:2] for r in rows if r[0] == 5], "user_id long, id long")
    kept.upsert(spark.createDataFrame([], ROWS), None, gone)
    assert len(told(kept.read())) == 66 and len(told(kept.read(1))) == 72
    kept.vacuum(1)
    assert len(told(kept.read())) == 66
    with pytest.raises(Exception):
        kept.read(1)


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    """A writer that dies before its manifest is made, and one that comes second: the version before stays, the next writer goes on."""
    rows = spark.createDataFrame([(1, 1, "c", "k1", DAY)], ROWS)
    kept = store.LedgerStore(spark, str(tmp_path / "l"), 4)
    kept.write(rows)
    more = spark.createDataFrame([(1, 2, "c", "k2", DAY)], ROWS)
    with monkeypatch.context() as m:
        m.setattr(manifest.Manifest, "commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            kept.upsert(more)
    assert kept.version() == 1 and told(kept.read()) == told(rows)
    with monkeypatch.context() as m:
        m.setattr(store.LedgerStore, "version", lambda self: 0)
        with pytest.raises(Exception, match="exist"):
            kept.upsert(more)
    assert told(kept.read()) == told(rows)
    assert kept.upsert(more) == 2 and len(told(kept.read())) == 2
    assert kept.vacuum(2) == 2  # what the two lost writers have left


# --- the standing index


@pytest.mark.parametrize("seed,fanout", [(0, 2)])
def test_index_equals_table(spark, tmp_path, seed, fanout):
    """Five additions, with merged levels, and rows taken out: the matches are those of the plain operator over the whole ledger."""
    rng = random.Random(seed)
    inc, led = spread(rng, 80), [(r[0] + 1_000, *r[1:]) for r in spread(rng, 200)]
    index = MatchIndex(spark, str(tmp_path / "i"), 4, fanout)
    held = held_of(spark, led).withColumn("dedup_key", F.concat(F.lit("k"), "id"))
    for i in range(5):
        index.add(held.filter(F.pmod("id", F.lit(5)) == i), i)
        index.add(held.filter(F.pmod("id", F.lit(5)) == i), i)  # a batch that comes again
    incoming = spark.createDataFrame(inc, PAYMENT)
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert same(index.find_duplicate(incoming), dedup.find_duplicate(incoming, held))
    assert len(index.runs("times")) <= fanout and index.last_batch() == 4
    gone = held.filter("id % 3 = 0")
    index.remove(gone)
    assert same(index.find_duplicate(incoming), dedup.find_duplicate(incoming, held.filter("id % 3 != 0")))
    keys = spark.createDataFrame([(1, "k1000"), (2, "k1001"), (1, "none")], "user_id long, dedup_key string")
    assert keys.join(index.held_keys(keys), ["user_id", "dedup_key"], "left_semi").count() == sum((r[1], f"k{r[0]}") in {(1, "k1000"), (2, "k1001")} for r in led)
    index.close()
    assert same(MatchIndex(spark, str(tmp_path / "i")).find_duplicate(incoming), dedup.find_duplicate(incoming, held.filter("id % 3 != 0")))  # opened anew


def exchanged_scans(df):
    """Scans of index runs with an exchange between them and their join."""
    lines, bad, scans = df._jdf.queryExecution().executedPlan().toString().split("\n"), [], 0
    depth = lambda x: len(re.match(r"[\s:+\-|*(\d)]*", x)[0])
    for i, x in enumerate(lines):
        if "FileScan parquet" in x and "spark_catalog" in x:
            scans, at = scans + 1, depth(x)
            for y in reversed(lines[:i]):
                if depth(y) < at:
                    at = depth(y)
                    if "Join" in y:
                        break
                    if "Exchange" in y:
                        bad.append(x)
                        break
    return scans, bad


def test_index_is_not_exchanged(spark, tmp_path, monkeypatch):
    from ledgerloom.streaming import index as module

    monkeypatch.setattr(module, "NAMED_KEYS", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rng = random.Random(5)
        index = MatchIndex(spark, str(tmp_path / "i"), 4, 8)
        for i in range(3):
            index.add(held_of(spark, spread(rng, 100)).withColumn("dedup_key", F.concat(F.lit(f"{i}k"), "id")), i)
        left = dedup._incoming_times(spark.createDataFrame(spread(rng, 100), PAYMENT), 0)
        met = index._met("times", left.select(F.xxhash64(*dedup.GROUP, F.floor(F.col("in_ms") / dedup.WIDE_MS).cast("long")).alias("k")))
        scans, bad = exchanged_scans(met)
        assert scans == 3 and not bad
        index.close()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stream_over_four_arrivals_equals_batches(spark, sf_dir, tmp_path):
    """Messages in four arrivals: the live ledger is that of four batches over the whole ledger each; a failed batch is done again."""
    rows = views.captures(spark, sf_dir)
    bounds = [r[0] for r in rows.selectExpr("explode(percentile(posted_at_ms, array(0.25, 0.5, 0.75)))").collect()]
    part = sum((F.coalesce((F.col("posted_at_ms") >= b).cast("int"), F.lit(0)) for b in bounds), F.lit(0))
    titled = lambda df: df.withColumn("title", F.lit(None).cast("string")).withColumn("raw_sender", F.col("sender")).withColumn("status", F.lit("pending"))
    blank = titled(messages.parse_captures(spark.createDataFrame([], captures.SCHEMA)))
    want, failing = blank, [True]
    index, path = MatchIndex(spark, str(tmp_path / "index"), 4, 2), str(tmp_path)

    def append(df, i):
        df.select(*blank.columns).write.mode("overwrite").parquet(f"{path}/ledger/batch={i}")
        if failing and i == 2:
            failing.clear()
            raise OSError("lost")
        return spark.read.schema(blank.schema).parquet(f"{path}/ledger/batch={i}")

    for k in range(4):
        own = rows.withColumn("part", part).filter(F.col("part") == k).drop("part")
        next_ = want.unionByName(titled(flows.ledger_rows(captures.exact_dedup(captures.prefilter(own)), want)).select(*blank.columns))
        want = spark.createDataFrame(next_.collect(), blank.schema)
        own.write.mode("append").parquet(f"{path}/in")
        start = lambda: ingest.stream_ingest(captures.read_captures(spark, f"{path}/in", stream=True), f"{path}/cp", append, index, lambda r, held: titled(flows.ledger_rows(r, held)))
        try:
            start().awaitTermination()
        except PySparkException:
            start().awaitTermination()
    shared = spark.conf.get("spark.checkpoint.dir")
    assert not [x for x in os.listdir(shared) if x.startswith("arrived-")]  # a batch takes its tables with it
    got = spark.read.schema(blank.schema).parquet(f"{path}/ledger").select("user_id", "id", "dedup_key").collect()
    assert not failing and sorted(map(tuple, got)) == sorted(map(tuple, want.select("user_id", "id", "dedup_key").collect()))
    index.close()
