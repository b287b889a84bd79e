"""Operators against plain restatements, invariants, and streams against batches."""

import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.functions import messages
from ledgerloom.operators import accounts, categories, dedup, flows, ledger, rules, statements
from ledgerloom.operators import splits as sp
from ledgerloom.plans import registry, views
from ledgerloom.sources import captures, files, snapshots
from ledgerloom.streaming import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[n]) for n in names) for r in df.collect()), key=repr) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def payments(rng, n):
    shops = ["swiggy", "swiggylimited", "dad", "dadar", None]
    return [
        (i, 1, rng.choice([500, 1000]), "debit", rng.randrange(4) * 3_000_000 + rng.randrange(6) * 200_000, rng.choice(shops), rng.choice(["123456", "999123456", "777777", None, None]), rng.choice(["sms", "notification"]))
        for i in range(n)
    ]


PAYMENT = "id long, user_id long, amount_paise long, direction string, occurred_at_ms long, merchant string, reference string, origin string"


def plain_same(a, b, tight=600_000):
    apart = abs(a[4] - b[4])
    m, n = (x if x and len(x) >= 3 else None for x in (a[5], b[5]))
    alike = bool(m and n) and (m == n or min(len(m), len(n)) >= 4 and (m in n or n in m))
    return (not m or not n or alike) if apart <= tight else a[7] != b[7] and apart <= 43_200_000 and alike


def plain_refs(a, b):
    return bool(a[6] and b[6]) and any(f(x, y) for x, y in ((a[6], b[6]), (b[6], a[6])) for f in (str.startswith, str.endswith))


@pytest.mark.parametrize("seed", range(4))
def test_collapse_equals_loop(spark, seed):
    rows = payments(random.Random(seed), 60)
    got = {r["id"]: r["match_id"] for r in dedup.collapse_batch(spark.createDataFrame(rows, PAYMENT), [F.col("id")]).collect()}
    groups, want = defaultdict(list), {}
    for r in rows:
        held = groups[r[2]]
        refs = [h[0] for h in held if plain_refs(h, r)]
        near = sorted((abs(h[4] - r[4]), h[0]) for h in held if plain_same(h, r))
        want[r[0]] = min(refs) if refs else near[0][1] if near else None
        if want[r[0]] is None:
            held.append(r)
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_blocked_joins_equal_full_joins(spark, seed):
    rng = random.Random(seed)
    inc, led = payments(rng, 50), payments(rng, 80)
    incoming = spark.createDataFrame(inc, PAYMENT)
    held = spark.createDataFrame(led, PAYMENT).withColumn("source", F.col("origin")).withColumn("raw_sender", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string"))
    got = {(r["incoming_id"], r["ledger_id"]) for r in dedup.reference_pairs(incoming, held).collect()}
    assert got == {(a[0], b[0]) for a in inc for b in led if a[2] == b[2] and plain_refs(a, b)}
    got = {(r["incoming_id"], r["ledger_id"]) for r in dedup.near_pairs(incoming, held).collect()}
    assert got == {(a[0], b[0]) for a in inc for b in led if a[2] == b[2] and plain_same(a, b)}


def test_merge_is_idempotent(spark, sf_dir):
    rows = views.statement_rows(spark, sf_dir)
    empty = messages.parse_captures(views.captures(spark, sf_dir)).withColumn("title", F.lit(None).cast("string")).withColumn("raw_sender", F.col("sender")).withColumn("status", F.lit("pending")).limit(0)
    first = dedup.merge_statement(rows, empty, "table").cache()
    kept = first.filter("decision != 'duplicate'").select("user_id", "id").join(rows, ["user_id", "id"])
    again = kept.withColumn("title", F.lit(None).cast("string")).withColumn("source", F.lit("manual")).withColumn("raw_sender", F.lit("statement:table")).withColumn("status", F.lit("pending"))
    second = dedup.merge_statement(rows, again, "table")
    assert first.count() == rows.count() == second.count()
    assert second.filter("decision != 'duplicate'").count() == 0
    report = dedup.import_report(first).agg(F.sum("imported"), F.sum("duplicates")).first()
    assert report[0] + report[1] == rows.count() and report[0] == kept.count()


def test_supersede_truth_table(spark):
    rows = [("pending", "sms", "R12345"), ("confirmed", "sms", "R12345"), ("pending", "sms", None), ("pending", "statement", "R12345"), ("pending", "manual", "R12345")]
    df = spark.createDataFrame(rows, "s string, o string, r string")
    assert [r[0] for r in df.select(dedup.statement_supersedes(F.col("s"), F.col("o"), F.col("r"))).collect()] == [True, False, False, False, True]


def test_self_transfer(spark):
    parsed = spark.createDataFrame([(1, 1, 30, "1234", ["1234", "9999", "5678"]), (2, 1, 20, "7777", ["7777", "5678"]), (3, 1, 10, "5678", ["5678", "7777"])], "id long, user_id long, posted_at_ms long, last4 string, all_last4 array<string>")
    own = spark.createDataFrame([(1, 1, "a", "1234", "bank", False), (2, 1, "b", "5678", "bank", False), (3, 1, "c", "9999", "bank", True)], "id long, user_id long, name string, last4 string, kind string, archived boolean")
    assert sorted(r["id"] for r in accounts.is_self_transfer(parsed, own).collect()) == [1, 3]  # 7777 is known from message 2 on


def test_rule_bounds_and_order(spark):
    base = (None, "ashok", "", "any", "contains", None, None, None, 100, True, "manual", 0)
    make = lambda i, **k: (i, *[k.get(n, v) for n, v in zip(("user_id", "pattern", "category", "field", "match_type", "direction", "min_paise", "max_paise", "priority", "enabled", "origin", "hits"), base)])
    txn = spark.createDataFrame([(1, 1, "Ashok", 200000), (2, 1, "Ashok", 50000), (3, 2, "Ashok", 50000)], "id long, user_id long, merchant string, amount_paise long").withColumn("direction", F.lit("debit"))
    table = spark.createDataFrame([make(1, category="Rent", min_paise=100000), make(2, category="Gifts", max_paise=99999), make(3, category="Learned", origin="learned", hits=99), make(4, category="Own", user_id=2, priority=1), make(5, category="Bad", pattern="a(", match_type="regex", priority=0)], views.RULES_SCHEMA)
    got = {r["id"]: r["rule_category"] for r in rules.with_rule(txn, table).collect()}
    assert got == {1: "Rent", 2: "Gifts", 3: "Own"}


def test_rules_with_odd_patterns(spark):
    """A pattern is judged by the compiler that will run it, and one user's bad rule stops nobody's job."""
    base = ("any", "regex", None, None, None, 1, True, "manual", 0)
    table = spark.createDataFrame([(1, 1, "a{,3}", "Bad", *base), (2, 1, "[[]", "Bad", *base), (3, 1, r"^\p{L}+ \d{2}$", "Letters", *base), (4, None, "x(", "Bad", *base), (5, 2, "(?P<a>x)", "Bad", *base), (6, None, None, "Bad", *base)], views.RULES_SCHEMA)
    txn = spark.createDataFrame([(1, 1, "Ünï 12", 5, "debit"), (2, 2, "x", 5, "debit")], "id long, user_id long, merchant string, amount_paise long, direction string")
    assert {r["id"]: r["rule_category"] for r in rules.with_rule(txn, table).collect()} == {1: "Letters", 2: None}


def test_many_shared_rules(spark):
    made = [(i, None, f"shop{i:04d}", f"C{i}", "any", "contains", None, None, None, 1000 - i, True, "manual", 0) for i in range(450)]
    txn = spark.createDataFrame([(1, 1, "shop0003 shop0449 shop0200"), (2, 1, "shop0001")], "id long, user_id long, merchant string").withColumn("direction", F.lit("debit")).withColumn("amount_paise", F.lit(1).cast("long"))
    table = spark.createDataFrame(made, views.RULES_SCHEMA)
    assert {r["id"]: r["rule_category"] for r in rules.with_rule(txn, table).collect()} == {1: "C449", 2: "C1"}
    assert {r["id"]: sorted(r["matched"]) for r in rules.with_matches(txn, table).collect()} == {1: [3, 200, 449], 2: [1]}


def test_keywords_of_a_table(spark):
    table = spark.createDataFrame([("Pets", "vet", 2), ("Fuel", "pump", 1), ("Pets", "dog", 3)], "category string, keyword string, place int")
    assert rules.keywords_of(table) == {"Fuel": ["pump"], "Pets": ["vet", "dog"]}


def test_users_share_names_and_ids(spark):
    """What one user renames, owns or owes is not another's."""
    txn = spark.createDataFrame([(1, 1, 10, "Rent", 5), (2, 1, 10, "Rent", 5)], "user_id long, id long, account_id long, category string, amount_paise long")
    own = spark.createDataFrame([(1, 10, "Mine"), (2, 10, "Theirs")], "user_id long, id long, name string")
    assert {r["user_id"]: r["account_name"] for r in accounts.txn_with_account(txn, own).collect()} == {1: "Mine", 2: "Theirs"}
    table = spark.createDataFrame([(None, "Fuel"), (1, "Shop")], "user_id long, name string")
    renames = spark.createDataFrame([(1, "Rent", "House"), (2, "Rent", "SHOP"), (2, "A", "fuel"), (2, "B", "x"), (2, "B", "x"), (1, "A", "shop"), (1, "C", "  ")], "user_id long, old_name string, new_name string")
    judged = {(r["user_id"], r["old_name"]): r["reason"] for r in categories.judged_renames(renames, table).collect()}
    assert judged == {(1, "Rent"): None, (2, "Rent"): None, (2, "A"): "clash", (2, "B"): "repeated", (1, "A"): "clash", (1, "C"): "blank"}
    assert {r["user_id"]: r["category"] for r in categories.rename_categories(txn, renames, table).collect()} == {1: "House", 2: "SHOP"}
    people = spark.createDataFrame([(1, 7, "P"), (2, 7, "P")], "user_id long, id long, name string")
    split = spark.createDataFrame([(1, 7, False), (2, 7, True)], "user_id long, person_id long, settled boolean").withColumn("settled_at_ms", F.when(F.col("settled"), 5))
    assert [r["user_id"] for r in sp.deletable_people(people, split).collect()] == [2]
    moved = spark.createDataFrame([(1, "Rent", True), (None, "Fuel", True)], "user_id long, name string, money_moved boolean")
    assert {r["user_id"]: r["moved"] for r in ledger.is_moved(txn, moved).collect()} == {1: True, 2: False}


def test_conflicting_references_may_veto(spark):
    rows = [(1, 1, 500, "debit", 0, "swiggy", "AAAAAA111", "sms"), (2, 1, 500, "debit", 60_000, "swiggy", "BBBBBB222", "notification"), (3, 1, 500, "debit", 60_000, "swiggy", None, "notification")]
    df = spark.createDataFrame(rows, PAYMENT)
    held = df.filter("id = 1").withColumn("source", F.col("origin")).withColumn("raw_sender", F.lit(None).cast("string")).withColumn("title", F.lit(None).cast("string"))
    found = lambda **k: sorted(r["incoming_id"] for r in dedup.find_duplicate(df.filter("id > 1"), held, **k).collect())
    assert found() == [2, 3] and found(veto_conflicting_reference=True) == [3]


def test_drain_twice(spark, sf_dir):
    """Draining what has been drained adds nothing; own transfers are told from payments."""
    from ledgerloom.plans import ledger_queries

    rows = [(i, 1, "sms", "HDFCBK", f"Rs.{100 + i} debited from A/c XX1111 and credited to A/c XX{2222 if i < 3 else 3333}", 1_700_000_000_000 + i * 10**8) for i in range(6)]
    msgs = spark.createDataFrame(rows, captures.SCHEMA)
    own = spark.createDataFrame([(1, 1, "a", "1111", "bank", False), (2, 1, "b", "2222", "bank", False)], "id long, user_id long, name string, last4 string, kind string, archived boolean")
    none, blank = msgs.limit(0), ledger_queries.blank_ledger(messages.parse_captures(msgs)).limit(0)
    drain = lambda consumed, held, accts: flows.drain_batch(msgs, consumed, held, accts, views.category_rules(spark).limit(0), {}, most=4)
    first = drain(none, blank, own)
    assert [(r["imported"], r["skipped"]) for r in first.report.collect()] == [(4, 0)]
    assert sorted(r["category"] for r in first.ledger.collect()) == ["Other", "Other", "Other", "Transfers"]
    second = drain(first.consumed, first.ledger, first.accounts)
    assert second.ledger.count() == 6 and second.consumed.count() == 6
    third = drain(second.consumed, second.ledger, second.accounts)
    assert third.ledger.count() == 6 and third.report.count() == 0


def test_wallet_file_import(spark):
    from ledgerloom.plans import ledger_queries

    text = "Transaction Statement for 98xxxx\nDate Transaction Details UTR No. Amount\nJan 5, 2024\n10:30 am\nDEBIT ₹120.50\tPaid to SHOP ONE\nTransaction ID T1\nUTR No. 500000000001\nPaid by XX4321"
    files_ = spark.createDataFrame([(1, "w", text.encode()), (1, "x", b"PK\x03\x04zip"), (2, "e", b"")], "user_id long, file_id string, content binary")
    blank = ledger_queries.blank_ledger(messages.parse_captures(spark.createDataFrame([], captures.SCHEMA)))
    own = spark.createDataFrame([], "id long, user_id long, name string, last4 string, kind string, archived boolean")
    once = flows.import_statements(files_, blank, own, views.category_rules(spark).limit(0), {"Fuel": ["shop one"]})
    row = once.ledger.collect()
    assert [(r["user_id"], r["amount_paise"], r["category"], r["dedup_key"]) for r in row] == [(1, 12050, "Fuel", "stmt|phonepe|500000000001")]
    assert [(r["name"], r["last4"]) for r in once.accounts.collect()] == [("Card ••4321", "4321")]
    again = flows.import_statements(files_, once.ledger, once.accounts, views.category_rules(spark).limit(0), {})
    assert again.ledger.count() == 1 and again.accounts.count() == 1 and again.report.first()["duplicates"] == 1


def test_delimited_files():
    grid = files.grid
    assert grid("a;b;c\n1,5;2;3\n4,25;5;6\n") == [["a", "b", "c"], ["1,5", "2", "3"], ["4,25", "5", "6"]]
    assert grid('﻿d,n,a\r\n1,"x, y",2\r\n\r\n3,"say ""hi""",4\r\n5,"two\nlines",6') == [["d", "n", "a"], ["1", "x, y", "2"], ["3", 'say "hi"', "4"], ["5", "two\nlines", "6"]]
    assert grid("a\tb\tc\n1\t\t3\n4") == [["a", "b", "c"], ["1", None, "3"], ["4"]]
    assert grid("") == [] and files.sniff_delimiter("") == "," and files.sniff_delimiter("a|b\nc|d") == "|"
    assert files.looks_delimited("a,b,c") and not files.looks_delimited("a,b") and not files.looks_delimited("a,b,c\0")


def test_statement_without_header_skips_all(spark):
    cells = spark.createDataFrame([("f", i, j, "text") for i in range(3) for j in range(2)], "file_id string, row_idx int, col_idx int, cell string")
    assert statements.parse_table_statement(cells).count() == 0 and statements.skipped_rows(cells).first()["skipped"] == 3


def test_balances(spark):
    rows = [(1, 1, 1, 60000, "owed_to_me", False), (1, 2, 1, 10000, "i_owe", False), (1, 3, 2, 45000, "owed_to_me", False), (1, 4, 3, 10000, "i_owe", False), (1, 5, 4, 500, "owed_to_me", True)]
    df = spark.createDataFrame(rows, "user_id long, transaction_id long, person_id long, amount_paise long, direction string, settled boolean").withColumn("settled_at_ms", F.when(F.col("settled"), 5))
    assert {r["person_id"]: r["net_paise"] for r in sp.outstanding_balances(df).collect()} == {1: 50000, 2: 45000, 3: -10000}
    assert tuple(sp.total_outstanding(df).first())[1:] == (95000, 10000)


def test_upsert_ignores_known_keys(spark):
    held = spark.createDataFrame([(1, 1, "k1"), (1, 2, "k2")], "user_id long, id long, dedup_key string")
    new = spark.createDataFrame([(1, 10, "k1"), (1, 11, "k3"), (1, 12, "k3"), (2, 13, "k1")], held.schema)
    once = ledger.upsert(held, new)
    assert sorted(r["id"] for r in once.collect()) == [1, 2, 11, 13]
    assert ledger.upsert(once, new).count() == once.count()


def test_ledger_versions(spark, tmp_path):
    path, day = str(tmp_path / "l"), 86_400_000
    rows = spark.createDataFrame([(1, 1, 5 * day), (1, 2, 40 * day)], "user_id long, id long, occurred_at_ms long")
    ids = lambda version: sorted(r["id"] for r in ledger.read_ledger(spark, path, version).collect())
    ledger.write_ledger(rows, path, 1)
    ledger.write_ledger(ledger.read_ledger(spark, path, 1).filter("id = 1"), path, 2)
    assert ids(1) == [1, 2] and ids(2) == [1]  # the last row of a month and what it was before
    ledger.write_ledger(rows.filter("id = 2"), path, 2)
    assert ids(1) == [1, 2] and ids(2) == [2]


def test_snapshot_round_trip(spark):
    tables = {n: spark.createDataFrame([(u, i) for u in (1, 2) for i in range(u)], "user_id long, id long") for n in snapshots.TABLES}
    rows, refused = snapshots.snapshot_restore(snapshots.snapshot_export(tables, "now"), {n: "id: long" for n in snapshots.TABLES})
    assert refused.count() == 0
    for n in snapshots.TABLES:
        assert sorted(map(tuple, rows[n].collect())) == [(1, 0), (2, 0), (2, 1)]


def test_sources_and_stream(spark, sf_dir, tmp_path):
    rows = views.captures(spark, sf_dir)
    for fmt in ("parquet", "json", "csv"):
        w = rows.write.option("header", True) if fmt == "csv" else rows.write
        w.format(fmt).save(str(tmp_path / fmt))
        assert captures.read_captures(spark, str(tmp_path / fmt), fmt).exceptAll(rows).count() == 0
    blank = messages.parse_captures(rows).limit(0)
    batch = flows.ledger_rows(captures.exact_dedup(captures.prefilter(rows)), blank.withColumn("title", F.lit(None).cast("string")).withColumn("raw_sender", F.col("sender")).withColumn("status", F.lit("pending")))
    assert 0 < batch.count() < rows.count()


def test_stream_ledger_query(spark, sf_dir):
    from ledgerloom.plans import ledger_queries

    early, late = (captures.exact_dedup(captures.prefilter(x)) for x in ledger_queries.in_two(views.captures(spark, sf_dir)))
    blank = messages.parse_captures(early).limit(0).withColumn("raw_sender", F.col("sender")).withColumn("title", F.lit(None).cast("string")).withColumn("status", F.lit("pending"))
    first = flows.ledger_rows(early, blank).withColumn("title", F.lit(None).cast("string")).select(*blank.columns).cache()
    want = first.select(*ledger_queries.LEDGER).unionByName(flows.ledger_rows(late, first).select(*ledger_queries.LEDGER))
    got = entry.queries()["stream_ledger"](spark, sf_dir)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    copies = messages.parse_captures(captures.prefilter(views.captures(spark, sf_dir)))
    assert 0 < got.count() < copies.count()  # second-source copies are collapsed


def test_stream_totals_query(spark, sf_dir):
    got = entry.queries()["stream_totals"](spark, sf_dir)
    day = (F.floor(F.col("occurred_at_ms") / 86_400_000) * 86_400_000).alias("start_ms")
    want = messages.parse_captures(views.captures(spark, sf_dir)).groupBy("user_id", "direction", day).agg(F.count("*").alias("n"), F.sum("amount_paise").alias("total_paise"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_near_dup_stream_keeps_state(spark, tmp_path):
    """What an earlier batch accepted is known to later ones, in its window."""
    at, hour, path = 1_700_000_000_000, 3_600_000, str(tmp_path / "in")
    card, app = "Rs.500.00 spent on HDFC Bank Card x1234 at SWIGGY Ref 400001", "₹500.00 paid to SWIGGY Limited"
    arrivals = [
        [(1, 1, "sms", "HDFCBK", card, at), (2, 1, "sms", "HDFCBK", card, at + 300_000), (9, 2, "sms", "HDFCBK", card, at)], [(3, 1, "notification", "com.phonepe.app", app, at + 5 * hour)],
        [(4, 1, "notification", "com.phonepe.app", app, at + 30 * hour)], [(5, 1, "sms", "HDFCBK", card, at + 31 * hour), (6, 1, "notification", "com.phonepe.app", app, at + 60 * hour)],
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, captures.SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(captures.SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with ingest.with_rocksdb(spark):
        ingest.stream_near_dup(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["id"]: r["match_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: None, 2: 1, 3: 1, 4: None, 5: 4, 6: None, 9: None}


def test_near_dup_state_is_of_shards(spark, tmp_path):
    """Payments that share nothing make no key each: the state has an entry for a shard's 12 hours, and ids stay exact beside a missing one."""
    at, big = 1_700_000_000_000, 2**60 + 1
    say = lambda i: f"Rs.{100 + i}.00 spent on HDFC Bank Card x1234 at SWIGGY Ref {400000 + i}"
    rows = [(i, None if i % 7 == 0 else big + i % 5, "sms", "HDFCBK", say(i), at) for i in range(200)] + [(1000 + i, None if i % 7 == 0 else big + i % 5, "sms", "HDFCBK", say(i), at + 60_000) for i in range(200)]
    spark.createDataFrame(rows, captures.SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(captures.SCHEMA).parquet(str(tmp_path / "in"))
    with ingest.with_rocksdb(spark):
        run = ingest.stream_near_dup(stream, shards=3).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        run.awaitTermination()
    kept = max(o["numRowsTotal"] for p in run.recentProgress for o in p["stateOperators"])
    got = {r["id"]: (r["user_id"], r["match_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r[0]: (r[1], r[0] - 1000 if r[0] >= 1000 else None) for r in rows}
    assert 0 < kept < 100


def test_messages_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    """Reading messages costs by the row, and their files are small: tasks are as many as the rows need, not as the files' bytes say."""
    monkeypatch.setattr(views, "TASK_EVENTS", 50)
    events = views.table(spark, sf_dir, "events").count()
    sizes = views.captures(spark, sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == -(-events // 50) and max(sizes) < 50 * 4


def test_self_transfers_read_messages_once(spark, sf_dir):
    rows = messages.parse_captures(views.captures(spark, sf_dir))
    out = accounts.is_self_transfer(rows, views.accounts(spark, sf_dir))
    assert "spent" not in out._jdf.queryExecution().optimizedPlan().toString()
