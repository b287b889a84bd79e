"""Nearest matches, islands and the replayed import against plain loops, and their work on hot groups."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, islands

from .test_ledger_operators import PAYMENT, payments, plain_refs, plain_same

HOUR = 3_600_000
NAMES = ["swiggy", "swiggylimited", "theswiggyshop", "limited", "dad", "dadar", "abcd", "xabcdx", None]


def spread(rng, n, names=NAMES):
    """Payments of few amounts over days, with names that hold each other, and equal times."""
    return [
        (i, 1 + i % 2, rng.choice([500, 1000]), "debit", rng.randrange(40) * HOUR * 2 + rng.choice([0, 0, 1, 599_999, 600_000, 600_001]), rng.choice(names), rng.choice(["123456", "999123456", "123456777", None, None, None]), rng.choice(["sms", "notification"]))
        for i in range(n)
    ]


def held_of(spark, rows):
    none = F.lit(None).cast("string")
    return spark.createDataFrame(rows, PAYMENT).withColumn("source", F.col("origin")).withColumn("raw_sender", none).withColumn("title", none)


@pytest.mark.parametrize("seed,tight", [(1, 600_000), (2, 0)])
def test_nearest_equals_least_pair(spark, seed, tight):
    rng = random.Random(seed)
    inc, led = spread(rng, 150), [(r[0] + 1_000, *r[1:]) for r in spread(rng, 200)]
    found = dedup.match_near_duplicate(spark.createDataFrame(inc, PAYMENT), held_of(spark, led), tight).collect()
    want = {}
    for a in inc:
        near = sorted((abs(b[4] - a[4]), b[0]) for b in led if a[1:4] == b[1:4] and plain_same(b, a, tight))
        if near:
            want[a[0]] = near[0]
    assert {r["incoming_id"]: (r["apart_ms"], r["ledger_id"]) for r in found} == want and len(want) > 20


def test_nearest_is_linear_in_a_hot_group(spark):
    """10^5 equal amounts of one user in 12 hours: rows out of the join are as many as rows in, not their pairs."""
    n = 100_000
    made = lambda origin: spark.range(n).select(
        "id", F.lit(1).cast("long").alias("user_id"), F.lit(500).cast("long").alias("amount_paise"), F.lit("debit").alias("direction"), (F.col("id") * 431 % (12 * HOUR)).alias("occurred_at_ms"),
        F.lit("swiggy").alias("merchant"), F.lit(None).cast("string").alias("reference"), F.lit(origin).alias("origin"), F.lit(origin).alias("source"), F.lit(None).cast("string").alias("raw_sender"), F.lit(None).cast("string").alias("title"),
    )
    out = dedup.match_near_duplicate(made("sms"), made("notification")).agg(F.count("*"), F.sum("apart_ms")).first()
    assert tuple(out) == (n, 0)


def brute_islands(rows, gap):
    label = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a[1:4] == b[1:4] and (abs(a[4] - b[4]) <= gap or plain_refs(a, b)) and label[i] != label[j]:
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label


@pytest.mark.parametrize("seed", range(2))
def test_islands_hold_what_may_match(spark, seed):
    rng = random.Random(seed)
    rows = [(i, 1, rng.choice([1, 2]), "debit", rng.randrange(60) * 9 * HOUR, None, rng.choice(["123456", "999123456", "777777x", None, None, None, None, None]), "sms") for i in range(60)]
    frame = spark.createDataFrame(rows, PAYMENT).select("id", *dedup.GROUP, F.col("occurred_at_ms").alias("ms"), F.col("reference").alias("ref"))
    got = {r["id"]: r["island"] for r in islands.with_islands(frame, dedup.GROUP, dedup.WIDE_MS, 6).collect()}
    label = brute_islands(rows, dedup.WIDE_MS)
    for i in range(60):
        for j in range(i):
            if label[i] == label[j]:  # what may match shares an island
                assert got[i] == got[j]
    assert 10 < len(set(got.values())) <= len(set(label))


def test_hot_group_is_many_islands(spark):
    """A user's equal amounts, a third of all rows: one group, but an island for each burst, and tasks share them."""
    rows = spark.range(6_000).select("id", F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 3 == 0, 500).otherwise(F.col("id") + 1_000).cast("long").alias("amount_paise"), F.lit("debit").alias("direction"),
                                     (F.expr("id div 30") * 20 * HOUR + F.col("id") % 30).alias("occurred_at_ms"), F.lit("swiggy").alias("merchant"), F.lit(None).cast("string").alias("reference"), F.lit("sms").alias("origin"))
    out = dedup.collapse_batch(rows, [F.col("id")])
    assert out.filter("match_id is null").count() == 4_000 + 200
    hot = islands.with_islands(rows.filter("amount_paise = 500").withColumn("ms", F.col("occurred_at_ms")).withColumn("ref", F.col("reference")), dedup.GROUP, dedup.WIDE_MS, 6)
    assert hot.select("island").distinct().count() == 200


@pytest.mark.parametrize("seed", range(2))
def test_collapse_over_islands_equals_loop(spark, seed):
    rows = spread(random.Random(seed), 120)
    got = {r["id"]: r["match_id"] for r in dedup.collapse_batch(spark.createDataFrame(rows, PAYMENT), [-F.col("occurred_at_ms"), F.col("id")]).collect()}
    held, want = [], {}
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        refs = [h[0] for h in held if h[1:4] == r[1:4] and plain_refs(h, r)]
        near = sorted((abs(h[4] - r[4]), h[0]) for h in held if h[1:4] == r[1:4] and plain_same(h, r))
        want[r[0]] = min(refs) if refs else near[0][1] if near else None
        if want[r[0]] is None:
            held.append(r)
    assert got == want


STATEMENT = "id long, user_id long, amount_paise long, direction string, occurred_at_ms long, merchant string, reference string, has_exact_time boolean, file_id string"
LEDGER = "id long, user_id long, amount_paise long, direction string, occurred_at_ms long, merchant string, title string, reference string, source string, raw_sender string, status string, dedup_key string"


def plain_import(rows, ledger):
    """The loop of one import: (decision, ledger_id, deletes) of each row."""
    held = {r[1]: [] for r in rows}
    for i, user, amount, way, ms, m, title, ref, source, sender, status, key in ledger:
        origin = "statement" if sender and sender.startswith("statement:") else source
        held.setdefault(user, []).append(((0, i), amount, way, ms, m or title, ref, origin, status == "pending" and origin != "statement", key))
    out = {}
    for i, user, amount, way, ms, m, ref, exact, _ in sorted(rows):
        mine, found = held[user], None
        if ref or exact or m:
            a = (0, 0, 0, 0, ms, m, ref, "statement")
            same = [h for h in mine if h[1:3] == (amount, way)]
            refs = sorted(h for h in same if plain_refs((0,) * 6 + (h[5],), a))
            near = sorted((abs(h[3] - ms), h[0], h) for h in same if plain_same((0, 0, 0, 0, h[3], h[4], None, h[6]), a, 600_000 if exact else 0))
            found = min(refs) if refs else near[0][2] if near else None
        goes = bool(found and found[7] and ref)
        if goes:
            mine.remove(found)
        key = f"stmt|table|{ref}" if ref else f"stmt|table|{ms}|{amount}|{m or 'x'}"
        stays = (not found or goes) and all(h[8] != key for h in mine)
        if stays:
            mine.append(((1, i), amount, way, ms, m, ref, "statement", False, key))
        out[user, i] = ("duplicate" if not stays else "replaced" if goes else "imported", found[0][1] if found and found[0][0] == 0 else None, goes)
    return out


def merged(spark, rows, ledger):
    out = dedup.merge_statement(spark.createDataFrame(rows, STATEMENT), spark.createDataFrame(ledger, LEDGER), "table")
    return out, {(r["user_id"], r["id"]): (r["decision"], r["ledger_id"], r["deletes"]) for r in out.collect()}


def test_import_replaces_a_payment_once(spark):
    """Two rows of one statement that match one pending payment by either end of its reference: the first replaces it, the second is new."""
    ledger = [(7, 1, 500, "debit", 0, None, None, "111111222222", "sms", "BANK", "pending", "k|7")]
    rows = [(1, 1, 500, "debit", 30 * HOUR, None, "111111", False, "f"), (2, 1, 500, "debit", 60 * HOUR, None, "222222", False, "f")]
    out, got = merged(spark, rows, ledger)
    assert got == {(1, 1): ("replaced", 7, True), (1, 2): ("imported", None, False)} == plain_import(rows, ledger)
    assert tuple(dedup.import_report(out).first())[2:] == (2, 0, 1, 0)


def test_import_does_not_match_what_is_gone(spark):
    """Row 1 replaces a payment by its reference; row 2 resembles that payment by time and shop, but not row 1."""
    ledger = [(7, 1, 500, "debit", 10 * HOUR, "swiggy", None, "111111222222", "sms", "BANK", "pending", "k|7")]
    rows = [(1, 1, 500, "debit", 90 * HOUR, "other shop", "111111", False, "f"), (2, 1, 500, "debit", 12 * HOUR, "swiggy", None, False, "f")]
    _, got = merged(spark, rows, ledger)
    assert got == {(1, 1): ("replaced", 7, True), (1, 2): ("imported", None, False)} == plain_import(rows, ledger)


@pytest.mark.parametrize("seed", range(2))
def test_import_equals_loop(spark, seed):
    rng = random.Random(seed)
    ref = lambda: rng.choice(["123456", "999123456", "123456777", "777777", None, None])
    shop = lambda: rng.choice(["swiggy", "swiggylimited", "dadar", None])
    at = lambda: rng.randrange(12) * 5 * HOUR
    ledger = [(100 + i, 1 + i % 2, rng.choice([5, 6]), rng.choice(["debit", "credit"]), at(), shop(), rng.choice(["dadar", None]), r := ref(), "manual" if (own := rng.random() < 0.2) else "sms", "statement:table" if own else "BANK",
               rng.choice(["pending", "confirmed"]), f"stmt|table|{r}|{i}" if own and rng.random() < 0.5 else f"stmt|table|{r}" if own and r else f"k|{i}") for i in range(40)]
    seen = set()
    ledger = [r for r in ledger if (r[1], r[-1]) not in seen and not seen.add((r[1], r[-1]))]
    rows = [(i, 1 + i % 2, rng.choice([5, 6]), rng.choice(["debit", "credit"]), at(), shop(), ref(), rng.random() < 0.5, "f") for i in range(60)]
    _, got = merged(spark, rows, ledger)
    want = plain_import(rows, ledger)
    assert got == want
    told = defaultdict(int)
    for d, _, goes in want.values():
        told[d, goes] += 1
    assert told["replaced", True] and told["imported", False] and told["duplicate", False]


def test_matching_of_empty_tables(spark):
    none, held = spark.createDataFrame([], PAYMENT), held_of(spark, [])
    assert dedup.find_duplicate(none, held).count() == 0 == dedup.collapse_batch(none, [F.col("id")]).count()
    assert dedup.merge_statement(spark.createDataFrame([], STATEMENT), spark.createDataFrame([], LEDGER), "table").count() == 0
    assert dedup.find_duplicate(spark.createDataFrame(payments(random.Random(0), 5), PAYMENT), held).count() == 0


def test_merge_statement_reads_the_ledger_once(spark):
    """The ledger may be costly to make: its keys and its rows come from one pass."""
    read = spark.sparkContext.accumulator(0)
    schema = "id long, user_id long, amount_paise long, direction string, occurred_at_ms long, merchant string, title string, reference string, source string, raw_sender string, status string, dedup_key string"

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    held = [(i, 1, 100 * i, "debit", 1_000_000, "Swiggy", None, f"REF{100000 + i}", "sms", "HDFCBK", "pending", "stmt|table|REF100003" if i == 9 else f"k|{i}") for i in range(1, 11)]
    ledger = spark.createDataFrame(held, schema).coalesce(1).mapInPandas(counted, schema)
    rows = spark.createDataFrame([(1, 1, 100, "debit", 1_000_000, "Swiggy", "REF100001", False), (2, 1, 999, "debit", 1_000_000, "Zara", "REF100003", False), (3, 1, 998, "debit", 1_000_000, "Zara", "REF999999", False)], "id long, user_id long, amount_paise long, direction string, occurred_at_ms long, merchant string, reference string, has_exact_time boolean")
    got = {r["id"]: (r["decision"], r["ledger_id"]) for r in dedup.merge_statement(rows, ledger, "table").collect()}
    assert got == {1: ("replaced", 1), 2: ("duplicate", None), 3: ("imported", None)}
    assert read.value == len(held)
