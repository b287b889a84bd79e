"""Large files in splits and many rules by an index, against the plain parser and the plain rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rule_index, rules
from ledgerloom.plans import statement_queries, views
from ledgerloom.sources import files, large_files


def made_file(rng, delimiter, n):
    def cell():
        x = rng.choice(["", " ", "a", "12,5", "x;y", "long cell " * rng.randint(1, 9), "ünï", 'say "hi"', "two\nlines", "a\r\nb\n\nc", "|", "\t"])
        return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',;|\t\n\r"') else x

    return ("﻿" if rng.random() < 0.5 else "") + rng.choice(["\n", "\r\n"]).join(delimiter.join(cell() for _ in range(rng.randint(1, 6))) for _ in range(n)) + rng.choice(["", "\n", '\nopen "quote, to\nthe end'])


@pytest.mark.parametrize("seed,split", [(1, 64), (2, 700), (3, 1 << 20)])
def test_files_in_splits_equal_whole_files(spark, tmp_path, monkeypatch, seed, split):
    monkeypatch.setattr(large_files, "PARSED_LINES", 3)
    rng = random.Random(seed)
    texts = [made_file(rng, d, n) for d, n in ((",", 60), (";", 80), ("|", 5), ("\t", 1))] + ["", "\n\n", '"' + "never closed\n" * 90]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"f{i}.csv").write_bytes(t.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {(r["file_id"][-6:-4], r["row_idx"], r["col_idx"]): r["cell"] for r in large_files.read_delimited_files(spark, str(folder)).collect()}
        blocks = large_files.read_lines(spark, str(folder)).select("file_id", "block").distinct().count()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(f"f{i}", r, c): x for i, t in enumerate(texts) for r, row in enumerate(files.grid(t)) for c, x in enumerate(row) if x is not None}
    assert got == want and (blocks > 60 if split == 64 else blocks >= 6)


def test_large_file_is_many_tasks(spark, tmp_path):
    """One file of 2 MB in splits of 64 kB: the parse runs over its chunks, and no task holds the file."""
    (tmp_path / "one.csv").write_text("".join(f'{i},"a, b\nc {i}",x\n' for i in range(70_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 65_536)
    try:
        lines = large_files.read_lines(spark, str(tmp_path / "one.csv"))
        assert lines.rdd.getNumPartitions() > 16 and large_files.chunk_states(lines).count() > 16
        out = large_files.read_delimited_files(spark, str(tmp_path / "one.csv"))
        assert tuple(out.agg(F.count("*"), F.max("row_idx"), F.countDistinct("row_idx")).first()) == (210_000, 69_999, 70_000)
        assert [r["cell"] for r in out.filter("row_idx = 54321").orderBy("col_idx").collect()] == ["54321", "a, b\nc 54321", "x"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("seed,split", [(4, 400), (5, 1 << 20)])
def test_small_files_in_common_ones_equal_whole_files(spark, tmp_path, monkeypatch, seed, split):
    """Statements share files, wherever these are split and runs end; names may hold anything."""
    monkeypatch.setattr(large_files, "PARSED_LINES", 7)
    monkeypatch.setattr(large_files, "RUN_BYTES", 90)
    rng = random.Random(seed)
    texts = {f"{i}\t/ü\n%": made_file(rng, rng.choice(",;|\t"), rng.choice([1, 4, 30])) for i in range(12)} | {"empty": "", "null": None, "open": '"' + "never closed\n" * 90, "crs": 'a;"b\rc";d\r\re;f;g'}
    large_files.pack_files(spark.createDataFrame(list(texts.items()), "file_id string, text string").coalesce(3), str(tmp_path / "packed"))
    assert len(list((tmp_path / "packed").glob("part-*"))) == 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = {(r["file_id"], r["row_idx"], r["col_idx"]): r["cell"] for r in large_files.read_delimited_files(spark, str(tmp_path / "packed"), packed=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == {(f, r, c): x for f, t in texts.items() for r, row in enumerate(files.grid(t or "")) for c, x in enumerate(row) if x is not None}


def test_bytes_that_are_not_text_are_replaced(spark, tmp_path):
    (tmp_path / "odd.csv").write_bytes(b"a,\xff\xc3,b\n1,\xe2\x82\n,3\n")
    got = {(r["row_idx"], r["col_idx"]): r["cell"] for r in large_files.read_delimited_files(spark, str(tmp_path / "odd.csv")).collect()}
    assert got == {(r, c): x for r, row in enumerate(files.grid((tmp_path / "odd.csv").read_bytes().decode("utf-8", "replace"))) for c, x in enumerate(row) if x is not None}


def test_statements_do_not_cost_a_file_each(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(statement_queries, "shared_path", lambda _, name: str(tmp_path / name))
    out = statement_queries.read_delimited_files(spark, sf_dir)
    assert out.select("file_id").distinct().count() > len([p for p in tmp_path.rglob("part-*") if p.stat().st_size]) < 9


@pytest.mark.parametrize("text,rows", [('a""b,"c""d"', [["ab", 'c"d']]), ('"""",""', [['"', ""]]), ('x"1,2"y\r"a\nb"\r\n', [["x1,2y"], ["a\nb"]]), ("a,", [["a", ""]]), ('"', []), ('a,"b""', [["a", 'b"']]), ("\n", [[""]])])
def test_quoting_rules(text, rows):
    assert list(files._fields(text, ",")) == rows and files.sniff_delimiter(text + '\n"a;b;c;d";e') in ",;"


def made_rules(rng, n, users=(None, None, 1, 2)):
    kinds = ["contains", "starts_with", "ends_with", "equals", "regex"]
    words = ["swiggy", "Food", "a", "ab", "note 1", "xy", "é", "zzz never", "limited ", "SWI", " "]
    odd = ["^s.*y$", "foo?d", "a(", "(swiggy|food)", "no+te 1", "limi.*d", "[ab]b", "x*y", "\\bfood\\b", "swiggy.?l"]
    rows = []
    for i in range(n):
        kind = rng.choice(kinds)
        rows.append((i, rng.choice(users), rng.choice(odd if kind == "regex" else words), f"c{i}", rng.choice(["any", "merchant", "title", "note", "odd"]), kind, rng.choice([None, None, "debit"]), rng.choice([None, 50]), rng.choice([None, 90]), rng.randint(1, 5), rng.random() < 0.9, rng.choice(["manual", "learned"]), rng.randint(0, 3)))
    return rows


TXN = "user_id long, id long, title string, merchant string, note string, raw_body string, direction string, amount_paise long"


@pytest.mark.parametrize("seed", range(2))
def test_index_of_rules_equals_plain_rules(spark, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, "", "Swiggy Limited", "food court", "ab", "Note 1", "é x", "xy", " ", "noote 1", "limited"])
    txn = spark.createDataFrame([(rng.randint(1, 3), i, text(), text(), text(), text(), rng.choice(["debit", "credit"]), rng.choice([10, 60, 99])) for i in range(120)], TXN)
    table = spark.createDataFrame(made_rules(rng, 60), views.RULES_SCHEMA)
    named = lambda df: {(r["user_id"], r["id"]): (r["rule_id"], r["rule_category"]) for r in df.collect()}
    want = named(rules.with_rule(txn, table))
    assert named(rule_index.with_rule(txn, table)) == want and len({x for x in want.values()}) > 3


def test_ten_thousand_rules_cost_what_they_match(spark):
    """10,000 words and as many texts, each text holding one word: the pairs that are tested are about as many as match."""
    txn = spark.range(10_000).select(F.lit(1).cast("long").alias("user_id"), "id", F.concat(F.lit("Paid to shop"), F.sha2(F.col("id").cast("string"), 256).substr(1, 12), F.lit(" today")).alias("merchant"), F.lit("debit").alias("direction"), F.lit(5).cast("long").alias("amount_paise"), F.lit(None).cast("string").alias("raw_body"))
    table = spark.range(10_000).select("id", F.lit(None).cast("long").alias("user_id"), F.concat(F.lit("shop"), F.sha2(F.col("id").cast("string"), 256).substr(1, 12)).alias("pattern"), F.concat(F.lit("c"), "id").alias("category"), F.lit("merchant").alias("field"),
                                       F.when(F.col("id") % 2 == 0, "contains").otherwise("regex").alias("match_type"), F.lit(None).cast("string").alias("direction"), F.lit(None).cast("long").alias("min_paise"), F.lit(None).cast("long").alias("max_paise"), F.lit(1).alias("priority"), F.lit(True).alias("enabled"), F.lit("manual").alias("origin"), F.lit(0).cast("long").alias("hits"))
    good = table.withColumn("scope", F.lit("all")).withColumnRenamed("id", "rule_id").select("scope", "field", "rule_id", "pattern", "match_type")
    texts = rule_index.texts_of(txn, good, "raw_body").select("scope", "field", "hay").distinct()
    assert rule_index.candidates(texts, good).count() < 400_000  # of 10^8 pairs
    out = rule_index.with_rule(txn, table)
    assert out.filter("rule_id = id").count() == 10_000


@pytest.mark.parametrize("limits", [{"FEW": 2, "HOT": 3}, {"FEW": 0, "HOT": 1, "exchanged": lambda df: df.hint("merge")}, {"SAMPLE": 5, "BITS": 1 << 10, "CUT_BYTES": 16, "SIZES": (2, 1)}])
def test_index_of_rules_by_every_way(spark, monkeypatch, limits):
    """Users of many rules, texts of many rows, full bitmaps, samples of few texts: the rules found are the same."""
    for name, value in limits.items():
        monkeypatch.setattr(rule_index, name, value)
    rng = random.Random(7)
    text = lambda: rng.choice([None, "", "Swiggy Limited", "food court", "ab", "Note 1", "éé x", "xy", " ", "noote 1", "limited", "paid 500000000017/s"])
    txn = spark.createDataFrame([(rng.choice([1, 2, 3, None]), i, text(), text(), text(), text(), rng.choice(["debit", "credit"]), rng.choice([10, 60, 99])) for i in range(120)], TXN)
    more = [(100 + i, rng.choice([None, 1, 2]), p, f"d{i}", "any", k, None, None, None, rng.randint(1, 5), True, "manual", 0) for i, (p, k) in enumerate([("00000017/S", "contains"), ("500000000018", "contains"), ("^paid .*0000017/", "regex"), ("ÉÉ", "contains"), ("é x", "ends_with")])]
    table = spark.createDataFrame(made_rules(rng, 50) + more, views.RULES_SCHEMA)
    want = {(r["user_id"], r["id"], i) for r in rules.with_matches(txn, table).collect() for i in r["matched"]}
    got = [(r["user_id"], r["id"], r["rule_id"]) for r in rule_index.matches(txn, table).collect()]
    assert {g for g in got if g[0] is not None} == {w for w in want if w[0] is not None} and len(got) == len(set(got)) and len(got) > 100
    assert {g for g in got if g[0] is None} == {w for w in want if w[0] is None}


def test_rules_of_numbers_meet_few_texts(spark):
    """3,000 rules that look for numbers whose every three digits many texts hold, and which no text has: tested are a few pairs a rule, not rules times texts."""
    number = lambda add: F.concat(F.lit("paid by 5"), F.lpad((F.col("id") * 7 + add).cast("string"), 11, "0"), F.lit("/shop"))
    rows = spark.range(3_000)
    texts = rows.select(F.lit("all").alias("scope"), F.lit("any").alias("field"), number(0).alias("hay"))
    good = rows.select(F.lit("all").alias("scope"), F.lit("any").alias("field"), F.col("id").alias("rule_id"), F.substring(number(1), 9, 14).alias("pattern"), F.lit("contains").alias("match_type"))
    assert rule_index.candidates(texts, good).count() < 10_000


@pytest.mark.parametrize("pattern,run", [("^paid .*500/", "paid "), ("abc?d", None), ("abcd?e", "abc"), ("a+bcd*?efg", "efg"), ("(abc)", None), ("a.c", None), ("ABCD$", "abcd"), ("éabc", None), ("abc|d", None)])
def test_needed_run(spark, pattern, run):
    assert spark.range(1).select(rule_index.needed_run(F.lit(pattern))).first()[0] == run
    if run:
        assert re.search(re.escape(run), pattern.lower())
