"""Queries over the ledger: matching, accounts, rules, periods, totals, splits, categories, snapshots, streams."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import matching, messages, periods
from ..functions.text import day_of, ms_of
from ..operators import accounts as ac
from ..operators import categories as cat
from ..operators import dedup, flows, ledger, rule_index, rules, store
from ..operators import splits as sp
from ..sources import captures as cap
from ..sources import snapshot_parts as sparts
from ..sources import snapshots as snap
from ..sources.shared import shared_path, written
from ..streaming import ingest
from ..streaming.index import MatchIndex
from ..streaming.sums import signed
from . import views as v
from .message_queries import PARSED, PREFILTERED
from .registry import query
from .statement_queries import STMT_KEY, statement_files
from .views import sql

# --- matching

BARE = lambda c: f"(CASE WHEN length(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')) >= 6 THEN regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g') END)"
REFS = lambda a, b: f"coalesce(starts_with({a}, {b}) OR ends_with({a}, {b}) OR starts_with({b}, {a}) OR ends_with({b}, {a}), FALSE)"
IDENT = lambda c, n=3: f"(CASE WHEN length(regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')) >= {n} THEN regexp_replace(lower({c}), '[^a-z0-9]', '', 'g') END)"
SHOPS = lambda a, b: f"coalesce({a} = {b} OR (least(length({a}), length({b})) >= 4 AND (contains({a}, {b}) OR contains({b}, {a}))), FALSE)"

ON = "i.user_id = l.user_id AND i.amount_paise = l.amount_paise AND i.direction = l.direction"


def led_sql(name: str, source: str) -> str:
    """Ledger rows as they are matched, of parsed messages."""
    return f"""{name} AS MATERIALIZED (SELECT id, user_id, amount_paise, direction, occurred_at_ms, {IDENT("merchant")} AS m, source AS o, {BARE("reference")} AS r,
  CASE WHEN id % 4 = 0 THEN 'confirmed' ELSE 'pending' END AS status, dedup_key FROM {source})"""


def new_sql(name: str, source: str) -> str:
    """Incoming rows as they are matched, of parsed messages."""
    return f"{name} AS MATERIALIZED (SELECT id, user_id, amount_paise, direction, occurred_at_ms, posted_at_ms, {IDENT('merchant', 1)} AS m, source AS o, {BARE('reference')} AS r, dedup_key FROM {source})"


def same_sql(a: str, b: str, tight: int, at: str = "occurred_at_ms") -> str:
    apart = f"abs({a}.{at} - {b}.{at})"
    return f"(CASE WHEN {apart} <= {tight} THEN {a}.m IS NULL OR {b}.m IS NULL OR {SHOPS(f'{a}.m', f'{b}.m')} ELSE {a}.o <> {b}.o AND {apart} <= 43200000 AND {SHOPS(f'{a}.m', f'{b}.m')} END)"


def by_ref(name: str, inc: str, led: str) -> str:
    return f"{name} AS (SELECT i.user_id, i.id AS incoming_id, min(l.id) AS ledger_id FROM {inc} i JOIN {led} l ON {ON} AND {REFS('i.r', 'l.r')} GROUP BY 1, 2)"


def by_time(name: str, inc: str, led: str, tight: int) -> str:
    return f"""{name} AS (SELECT i.user_id, i.id AS incoming_id, first(l.id ORDER BY abs(i.occurred_at_ms - l.occurred_at_ms), l.id) AS ledger_id,
  min(abs(i.occurred_at_ms - l.occurred_at_ms)) AS apart_ms FROM {inc} i JOIN {led} l ON {ON} AND {same_sql('i', 'l', tight)} GROUP BY 1, 2)"""


def walk_sql(name: str, source: str, order: str, tight: int) -> tuple[str, str]:
    """The greedy pass over (user, amount, direction) groups, as a recursion that takes the next row of every group: (id, user_id, match_id)."""
    row = "{'id': s.id, 'ms': s.occurred_at_ms, 'm': s.m, 'o': s.o, 'r': s.r}"
    near = same_sql("s", "x", tight).replace("x.occurred_at_ms", "x.ms")
    found = f"""coalesce(list_min(list_transform(list_filter(w.held, lambda x: {REFS('s.r', 'x.r')}), lambda x: x.id)),
      list_sort(list_transform(list_filter(w.held, lambda x: coalesce({near}, FALSE)), lambda x: {{'apart': abs(x.ms - s.occurred_at_ms), 'id': x.id}}))[1].id)"""
    seq = f"{name}_seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, amount_paise, direction ORDER BY {order}) AS seq FROM {source})"
    walk = f"""{name} AS (SELECT s.user_id, s.amount_paise, s.direction, s.seq, s.id, CAST(NULL AS BIGINT) AS match_id, [{row}] AS held FROM {name}_seq s WHERE s.seq = 1
  UNION ALL SELECT s.user_id, s.amount_paise, s.direction, s.seq, s.id, s.f, CASE WHEN s.f IS NULL THEN list_append(s.held, {row}) ELSE s.held END
  FROM (SELECT s.*, w.held, {found} AS f FROM {name} w JOIN {name}_seq s ON s.user_id = w.user_id AND s.amount_paise = w.amount_paise AND s.direction = w.direction AND s.seq = w.seq + 1) s)"""
    return seq, walk


#: The parsed messages stand for the ledger, the statement rows for what comes in.
INC = f"""inc AS MATERIALIZED (SELECT id, user_id, file_id, amount_paise, direction, occurred_at_ms, {IDENT("merchant", 1)} AS m, 'statement' AS o, {BARE("reference")} AS r, reference,
  {STMT_KEY} AS dedup_key FROM statement_rows)"""
BASE = (PARSED, led_sql("led", "parsed"), INC, by_ref("by_ref", "inc", "led"), by_time("by_time", "inc", "led", 0))


def led(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = messages.parse_captures(v.captures(spark, sf_dir)).withColumn("title", F.lit(None).cast("string")).withColumn("raw_sender", F.col("sender"))
    return rows.withColumn("status", F.when(F.col("id") % 4 == 0, "confirmed").otherwise("pending"))


def inc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.statement_rows(spark, sf_dir).withColumn("origin", F.lit("statement"))


@query("references_match", sql(f"SELECT id, {REFS(BARE('reference'), BARE('other'))} AS same FROM (SELECT id, reference, CASE id % 4 WHEN 0 THEN right(reference, 6) WHEN 1 THEN left(reference, 5) WHEN 2 THEN lower(reference) || 'x' ELSE 'ref-' || reference END AS other FROM statement_rows)"))
def references_match(spark, sf_dir):
    ref = F.col("reference")
    other = F.when(F.col("id") % 4 == 0, F.right(ref, F.lit(6))).when(F.col("id") % 4 == 1, F.left(ref, F.lit(5))).when(F.col("id") % 4 == 2, F.concat(F.lower(ref), F.lit("x"))).otherwise(F.concat(F.lit("ref-"), ref))
    return v.statement_rows(spark, sf_dir).select("id", matching.references_match(matching.bare_reference(ref), matching.bare_reference(other)).alias("same"))


@query("merchants_match", sql(f"SELECT id, {SHOPS('a', 'b')} AS same FROM (SELECT id, {IDENT('merchant')} AS a, CASE id % 4 WHEN 0 THEN 'swiggy' WHEN 1 THEN 'hpcl' WHEN 2 THEN 'bli' ELSE 'thenetflixshop' END AS b FROM transactions)"))
def merchants_match(spark, sf_dir):
    other = v.one_of(F.col("id") % 4, ["swiggy", "hpcl", "bli", "thenetflixshop"])
    return v.transactions(spark, sf_dir).select("id", matching.merchants_match(messages.merchant_identity(F.col("merchant")), other).alias("same"))


@query(
    "is_same_payment",
    sql(f"""SELECT id, CASE WHEN d <= 600000 THEN a IS NULL OR b IS NULL OR {SHOPS('a', 'b')} ELSE o <> 'sms' AND d <= 43200000 AND {SHOPS('a', 'b')} END AS same
FROM (SELECT id, {IDENT('merchant')} AS a, CASE WHEN id % 5 = 0 THEN NULL ELSE 'swiggy' END AS b, source AS o, (id % 100) * 600000 AS d FROM transactions)"""),
)
def is_same_payment(spark, sf_dir):
    at = F.col("occurred_at_ms")
    other = F.when(F.col("id") % 5 != 0, "swiggy")
    same = matching.is_same_payment(at, messages.merchant_identity(F.col("merchant")), F.col("source"), at + F.col("id") % 100 * 600000, other, F.lit("sms"))
    return v.transactions(spark, sf_dir).select("id", same.alias("same"))


@query("match_by_reference", sql("SELECT * FROM by_ref", *BASE))
def match_by_reference(spark, sf_dir):
    return dedup.match_by_reference(inc(spark, sf_dir), led(spark, sf_dir))


@query("match_near_duplicate", sql("SELECT * FROM by_time", *BASE))
def match_near_duplicate(spark, sf_dir):
    return dedup.match_near_duplicate(inc(spark, sf_dir), led(spark, sf_dir), 0)


FOUND = """found AS (SELECT coalesce(r.user_id, t.user_id) AS user_id, coalesce(r.incoming_id, t.incoming_id) AS incoming_id, CASE WHEN r.ledger_id IS NULL THEN 2 ELSE 1 END AS layer,
  coalesce(r.ledger_id, t.ledger_id) AS ledger_id FROM by_ref r FULL JOIN by_time t ON r.user_id = t.user_id AND r.incoming_id = t.incoming_id)"""


@query("find_duplicate", sql("SELECT * FROM found", *BASE, FOUND))
def find_duplicate(spark, sf_dir):
    return dedup.find_duplicate(inc(spark, sf_dir), led(spark, sf_dir), 0)


NEWEST = "posted_at_ms DESC, id DESC"


@query("collapse_batch", sql("SELECT id, user_id, match_id FROM walk", PARSED, new_sql("came", "parsed"), *walk_sql("walk", "came", NEWEST, 600000)))
def collapse_batch(spark, sf_dir):
    rows = led(spark, sf_dir).withColumn("origin", F.col("source"))
    return dedup.collapse_batch(rows, [-F.col("posted_at_ms"), -F.col("id")])


@query(
    "statement_supersedes",
    sql("""SELECT f.incoming_id AS id, l.status = 'pending' AND i.reference IS NOT NULL AS replaces FROM found f JOIN led l ON l.id = f.ledger_id AND l.user_id = f.user_id
JOIN inc i ON i.id = f.incoming_id AND i.user_id = f.user_id""", *BASE, FOUND),
)
def statement_supersedes(spark, sf_dir):
    held = led(spark, sf_dir).select("id", *dedup.GROUP, "occurred_at_ms", "merchant", "title", "reference", "source", "raw_sender", "status")
    incoming, held = inc(spark, sf_dir), written(held, "ledger")  # read from the messages once
    found = dedup.find_duplicate(incoming, held, 0).withColumnRenamed("incoming_id", "id")
    both = found.join(incoming.select("user_id", "id", "reference"), ["user_id", "id"]).join(held.select("user_id", F.col("id").alias("ledger_id"), "status", "source", "raw_sender"), ["user_id", "ledger_id"])
    return both.select("id", dedup.statement_supersedes(F.col("status"), messages.capture_origin(F.col("source"), F.col("raw_sender")), F.col("reference")).alias("replaces"))


def replay_sql(name: str, inc: str, led: str, tight: int) -> tuple[str, ...]:
    """A user's statement rows taken one after the other against the ledger as it is by then: the loop of one import, as a recursion over rows with the ledger as a list."""
    held = "{'k': 0, 'id': id, 'ms': occurred_at_ms, 'amt': amount_paise, 'way': direction, 'm': m, 'o': o, 'r': r, 'may': status = 'pending' AND o <> 'statement'}"
    own = "{'k': 1, 'id': q.id, 'ms': q.occurred_at_ms, 'amt': q.amount_paise, 'way': q.direction, 'm': q.m, 'o': q.o, 'r': q.r, 'may': FALSE}"
    near = same_sql("s", "x", tight).replace("x.occurred_at_ms", "x.ms")
    alike = "x.amt = s.amount_paise AND x.way = s.direction"
    first = f"list_sort(list_transform(list_filter(w.held, lambda x: {alike} AND {REFS('s.r', 'x.r')}), lambda x: {{'apart': CAST(0 AS BIGINT), 'k': x.k, 'id': x.id, 'may': x.may}}))[1]"
    close = f"list_sort(list_transform(list_filter(w.held, lambda x: {alike} AND coalesce({near}, FALSE)), lambda x: {{'apart': abs(x.ms - s.occurred_at_ms), 'k': x.k, 'id': x.id, 'may': x.may}}))[1]"
    looks = "(s.reference IS NOT NULL OR s.m IS NOT NULL)"
    lists = f"{name}_held AS MATERIALIZED (SELECT user_id, list({held}) AS held FROM {led} GROUP BY 1)"
    seq = f"{name}_seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS seq FROM {inc})"
    walk = f"""{name}(user_id, seq, id, file_id, dedup_key, ledger_id, decision, deletes, held, keys) AS (
  SELECT u.user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), FALSE, coalesce(h.held, []), CAST([] AS VARCHAR[])
    FROM (SELECT DISTINCT user_id FROM {inc}) u LEFT JOIN {name}_held h ON h.user_id = u.user_id
  UNION ALL SELECT q.user_id, q.seq, q.id, q.file_id, q.dedup_key, CASE WHEN q.f.k = 0 THEN q.f.id END, CASE WHEN NOT q.stays THEN 'duplicate' WHEN q.goes THEN 'replaced' ELSE 'imported' END, q.goes,
    list_concat(CASE WHEN q.goes THEN list_filter(q.held, lambda x: x.k <> 0 OR x.id <> q.f.id) ELSE q.held END, CASE WHEN q.stays THEN [{own}] ELSE [] END),
    CASE WHEN q.stays THEN list_append(q.keys, q.dedup_key) ELSE q.keys END
  FROM (SELECT p.*, (p.f IS NULL OR p.goes) AND NOT list_contains(p.keys, p.dedup_key) AS stays FROM (
    SELECT o.*, coalesce(o.f.may AND o.reference IS NOT NULL, FALSE) AS goes FROM (
      SELECT s.*, w.held, w.keys, CASE WHEN {looks} THEN coalesce({first}, {close}) END AS f FROM {name} w JOIN {name}_seq s ON s.user_id = w.user_id AND s.seq = w.seq + 1) o) p) q)"""
    return lists, seq, walk


MERGE = (PARSED, led_sql("led", "parsed"), INC, *replay_sql("replay", "inc", "led", 0), "decided AS (SELECT user_id, file_id, id, dedup_key, ledger_id, decision, deletes FROM replay WHERE seq > 0)")


@query("merge_statement", sql("SELECT * FROM decided", *MERGE))
def merge_statement(spark, sf_dir):
    return dedup.merge_statement(v.statement_rows(spark, sf_dir), led(spark, sf_dir), "table")


@query(
    "import_report",
    sql("""SELECT user_id, file_id, count(*) FILTER (WHERE decision <> 'duplicate') AS imported, count(*) FILTER (WHERE decision = 'duplicate') AS duplicates,
  count(*) FILTER (WHERE deletes) AS replaced, CAST(0 AS BIGINT) AS unparsed FROM decided GROUP BY 1, 2""", *MERGE),
)
def import_report(spark, sf_dir):
    return dedup.import_report(merge_statement(spark, sf_dir))


# --- accounts

KIND = "CASE WHEN lower(body) LIKE '%credit card%' OR lower(body) LIKE '%cc %' THEN 'credit_card' WHEN lower(body) LIKE '%debit card%' THEN 'debit_card' WHEN lower(body) LIKE '%upi%' OR lower(body) LIKE '%vpa%' THEN 'upi' ELSE 'bank' END"
KNOWN = "known AS (SELECT user_id, last4, min(id) AS account_id FROM accounts WHERE NOT archived GROUP BY 1, 2)"


@query("guess_account_kind", sql(f"SELECT id, {KIND} AS kind FROM captures"))
def guess_account_kind(spark, sf_dir):
    return v.captures(spark, sf_dir).select("id", ac.guess_account_kind(F.col("body")).alias("kind"))


@query(
    "resolve_account_last4",
    sql(f"""SELECT p.id, k.account_id, CASE WHEN k.account_id IS NULL AND p.last4 IS NOT NULL THEN 'Card ••' || p.last4 END AS new_name,
  CASE WHEN k.account_id IS NULL AND p.last4 IS NOT NULL THEN {KIND} END AS new_kind FROM parsed p LEFT JOIN known k ON p.user_id = k.user_id AND p.last4 = k.last4""", PARSED, KNOWN),
)
def resolve_account_last4(spark, sf_dir):
    return ac.resolve_account_last4(led(spark, sf_dir), v.accounts(spark, sf_dir)).select("id", "account_id", "new_name", "new_kind")


@query(
    "new_accounts",
    sql(f"""SELECT p.user_id, p.last4, 'Card ••' || p.last4 AS name, first({KIND} ORDER BY posted_at_ms DESC, id) AS kind FROM parsed p
LEFT JOIN known k ON p.user_id = k.user_id AND p.last4 = k.last4 WHERE k.account_id IS NULL AND p.last4 IS NOT NULL GROUP BY 1, 2""", PARSED, KNOWN),
)
def new_accounts(spark, sf_dir):
    return ac.new_accounts(ac.resolve_account_last4(led(spark, sf_dir), v.accounts(spark, sf_dir)))


@query(
    "resolve_account_mask",
    sql("""SELECT s.id, k.account_id, CASE WHEN account_mask IS NOT NULL AND k.account_id IS NULL THEN CASE WHEN account_mask = 'XX1234' THEN 'Card ••1234' ELSE 'UPI ••9876543210' END END AS new_name,
  CASE WHEN account_mask IS NOT NULL AND k.account_id IS NULL THEN CASE WHEN account_mask = 'XX1234' THEN 'debit_card' ELSE 'upi' END END AS new_kind
FROM statement_rows s LEFT JOIN known k ON s.user_id = k.user_id AND account_mask = 'XX1234' AND k.last4 = '1234'""", KNOWN),
)
def resolve_account_mask(spark, sf_dir):
    return ac.resolve_account_mask(v.statement_rows(spark, sf_dir), v.accounts(spark, sf_dir)).select("id", "account_id", "new_name", "new_kind")


SELF = """quoted AS (SELECT id, user_id, posted_at_ms, last4, unnest(list_distinct([last4, CAST(1000 + (10 * user_id + (id // 2 + 1) % 12) % 97 AS VARCHAR)])) AS n FROM parsed WHERE last4 IS NOT NULL),
own AS (SELECT user_id, last4, CAST(NULL AS BIGINT) AS at, CAST(NULL AS BIGINT) AS id FROM accounts WHERE NOT archived UNION ALL SELECT user_id, last4, posted_at_ms, id FROM parsed WHERE last4 IS NOT NULL)"""


@query(
    "is_self_transfer",
    sql("""SELECT user_id, id FROM (SELECT DISTINCT q.user_id, q.id, q.n FROM quoted q JOIN own o ON o.user_id = q.user_id AND o.last4 = q.n
  AND (o.at IS NULL OR o.at > q.posted_at_ms OR (o.at = q.posted_at_ms AND o.id > q.id))) GROUP BY 1, 2 HAVING count(*) >= 2""", PARSED, SELF),
)
def is_self_transfer(spark, sf_dir):
    second = (1000 + (10 * F.col("user_id") + (F.expr("id div 2") + 1) % 12) % 97).cast("string")
    rows = led(spark, sf_dir).withColumn("all_last4", F.when(F.col("last4").isNotNull(), F.array_distinct(F.array("last4", second))))
    return ac.is_self_transfer(rows, v.accounts(spark, sf_dir))


@query("txn_with_account", sql("SELECT t.id, t.user_id, a.name AS account_name FROM transactions t LEFT JOIN accounts a ON a.id = t.account_id AND a.user_id = t.user_id"))
def txn_with_account(spark, sf_dir):
    return ac.txn_with_account(v.transactions(spark, sf_dir), v.accounts(spark, sf_dir)).select("id", "user_id", "account_name")


# --- rules

HAY = "lower(concat_ws(' ', nullif(title, ''), nullif(merchant, ''), nullif(raw_body, '')))"
FIELD = f"CASE field WHEN 'merchant' THEN lower(coalesce(merchant, '')) WHEN 'title' THEN lower(coalesce(title, '')) WHEN 'note' THEN '' ELSE {HAY} END"
GOOD = "good AS MATERIALIZED (SELECT * FROM category_rules WHERE enabled AND pattern <> '' AND pattern NOT LIKE '%(')"


def hits_sql(table: str) -> tuple[str, ...]:
    """(matches, ruled): every rule that matches a row of the table, and the rows with the first of them."""
    matches = f"""matches AS MATERIALIZED (SELECT t.id, t.user_id, r.id AS rule_id, r.category AS rule_category,
    row_number() OVER (PARTITION BY t.user_id, t.id ORDER BY priority, CASE WHEN origin = 'manual' THEN 0 ELSE 1 END, hits DESC, r.id) AS n
  FROM (SELECT *, {HAY} AS hay FROM {table}) t JOIN good r ON (r.user_id IS NULL OR r.user_id = t.user_id) AND (r.direction IS NULL OR r.direction = t.direction)
  AND (min_paise IS NULL OR amount_paise >= min_paise) AND (max_paise IS NULL OR amount_paise <= max_paise)
  AND CASE match_type WHEN 'regex' THEN regexp_matches({FIELD}, '(?i)' || pattern) WHEN 'starts_with' THEN starts_with({FIELD}, lower(pattern)) WHEN 'ends_with' THEN ends_with({FIELD}, lower(pattern))
      WHEN 'equals' THEN trim({FIELD}) = lower(pattern) ELSE contains({FIELD}, lower(pattern)) END)"""
    return GOOD, matches, f"ruled AS (SELECT t.*, rule_id, rule_category FROM {table} t LEFT JOIN (SELECT * FROM matches WHERE n = 1) m ON m.id = t.id AND m.user_id = t.user_id)"


HITS = hits_sql("transactions")


@query("rule_haystack", sql(f"SELECT id, {HAY} AS hay, lower(coalesce(merchant, '')) AS merchant_hay FROM transactions"))
def rule_haystack(spark, sf_dir):
    txn = v.transactions(spark, sf_dir)
    hay = lambda f: rules.rule_haystack(rules.subject_of(txn), F.lit(f))
    return txn.select("id", hay("any").alias("hay"), hay("merchant").alias("merchant_hay"))


@query(
    "rule_text_match",
    sql("""SELECT id, k, CASE k WHEN 0 THEN contains(m, 'swiggy') WHEN 1 THEN starts_with(m, 'hpcl') WHEN 2 THEN ends_with(m, 'limited') WHEN 3 THEN trim(m) = 'netflix' ELSE regexp_matches(m, '^b.*t$') END AS hit
FROM (SELECT id, lower(coalesce(merchant, '')) AS m FROM transactions), (SELECT unnest([0, 1, 2, 3, 4]) AS k)"""),
)
def rule_text_match(spark, sf_dir):
    tests = [("Swiggy", "contains"), ("HPCL", "starts_with"), ("limited", "ends_with"), ("netflix", "equals"), ("^B.*T$", "regex")]
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(p).alias("p"), F.lit(t).alias("t")) for i, (p, t) in enumerate(tests)])).alias("r")
    rows = v.transactions(spark, sf_dir).select("id", F.lower(F.coalesce("merchant", F.lit(""))).alias("m"), kinds)
    return rows.select("id", "r.k", rules.rule_text_match(F.col("m"), F.col("r.p"), F.col("r.t")).alias("hit"))


@query("rule_matches", sql("SELECT rule_id, user_id, count(*) AS n FROM matches GROUP BY 1, 2", *HITS))
def rule_matches(spark, sf_dir):
    rows = rules.with_matches(v.transactions(spark, sf_dir), v.category_rules(spark))
    return rows.select(F.explode("matched").alias("rule_id"), "user_id").groupBy("rule_id", "user_id").agg(F.count("*").alias("n"))


@query(
    "order_rules",
    sql("SELECT id, CAST(row_number() OVER (ORDER BY priority, CASE WHEN origin = 'manual' THEN 0 ELSE 1 END, hits DESC, id) AS INTEGER) AS place, category, n FROM (SELECT r.*, u.n FROM category_rules r JOIN (SELECT category, count(*) AS n FROM transactions GROUP BY 1) u USING (category))"),
)
def order_rules(spark, sf_dir):
    from pyspark.sql import Window as W

    used = v.transactions(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    listed = v.category_rules(spark).join(used, "category")
    return rules.order_rules(listed).withColumn("place", F.row_number().over(W.orderBy(*rules.order_key()))).select("id", "place", "category", "n")


@query("category_from_rules", sql("SELECT id, rule_id, rule_category FROM ruled", *HITS))
def category_from_rules(spark, sf_dir):
    return rules.with_rule(v.transactions(spark, sf_dir), v.category_rules(spark)).select("id", "rule_id", "rule_category")


#: Rules in number: a user's own for every ninth payment, by its reference in the message, and one for all users for every hundredth, by its note or shop.
MANY_RULES = """many_rules AS MATERIALIZED (SELECT * FROM category_rules UNION ALL
  SELECT 1000 + id, user_id, CAST(500000000000 + id AS VARCHAR), 'Own ' || (id % 7), 'any', CASE id % 3 WHEN 0 THEN 'contains' ELSE 'ends_with' END, CASE WHEN id % 4 = 0 THEN 'debit' END, NULL, NULL, 45 + id % 9, id % 18 <> 0, 'learned', id % 5 FROM transactions WHERE id % 9 = 0
  UNION ALL SELECT 5000000 + id, NULL, CASE id % 300 WHEN 0 THEN 'TE ' || (id % 20) WHEN 100 THEN (500000000000 + id) || '/s' ELSE '^paid .*' || (500000000000 + id) || '/' END, 'All ' || (id % 5), CASE id % 300 WHEN 0 THEN 'title' ELSE 'any' END,
    CASE id % 300 WHEN 200 THEN 'regex' ELSE 'contains' END, NULL, CASE WHEN id % 8 = 0 THEN 1000000 END, NULL, 60, TRUE, 'manual', 0 FROM transactions WHERE id % 100 = 0)"""


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, key, none = v.transactions(spark, sf_dir).select("id", "user_id"), F.col("id"), F.lit(None)
    number = (500000000000 + key).cast("string")
    own = t.filter("id % 9 = 0").select(
        (1000 + key).alias("id"), "user_id", number.alias("pattern"), F.concat(F.lit("Own "), key % 7).alias("category"), F.lit("any").alias("field"), F.when(key % 3 == 0, "contains").otherwise("ends_with").alias("match_type"),
        F.when(key % 4 == 0, "debit").alias("direction"), none.cast("long").alias("min_paise"), none.cast("long").alias("max_paise"), (45 + key % 9).cast("int").alias("priority"), (key % 18 != 0).alias("enabled"), F.lit("learned").alias("origin"), (key % 5).alias("hits"),
    )
    kind = key % 300
    shared = t.filter("id % 100 = 0").select(
        (5000000 + key).alias("id"), none.cast("long").alias("user_id"), F.when(kind == 0, F.concat(F.lit("TE "), key % 20)).when(kind == 100, F.concat(number, F.lit("/s"))).otherwise(F.concat(F.lit("^paid .*"), number, F.lit("/"))).alias("pattern"),
        F.concat(F.lit("All "), key % 5).alias("category"), F.when(kind == 0, "title").otherwise("any").alias("field"), F.when(kind == 200, "regex").otherwise("contains").alias("match_type"), none.cast("string").alias("direction"),
        F.when(key % 8 == 0, 1000000).cast("long").alias("min_paise"), none.cast("long").alias("max_paise"), F.lit(60).alias("priority"), F.lit(True).alias("enabled"), F.lit("manual").alias("origin"), F.lit(0).cast("long").alias("hits"),
    )
    return v.category_rules(spark).unionByName(own).unionByName(shared)


MANY_HITS = (MANY_RULES, *(c.replace("FROM category_rules WHERE", "FROM many_rules WHERE") for c in HITS))


@query("category_from_many_rules", sql("SELECT id, rule_id, rule_category FROM ruled", *MANY_HITS))
def category_from_many_rules(spark, sf_dir):
    """Rules that grow with the rows, by an inverted index."""
    return rule_index.with_rule(v.transactions(spark, sf_dir), many_rules(spark, sf_dir)).select("id", "rule_id", "rule_category")


def keyword_sql(h: str) -> str:
    return f"""CASE WHEN direction = 'debit' AND contains({h}, 'swiggy') THEN 'Food & Dining' WHEN direction = 'debit' AND contains({h}, 'blinkit') THEN 'Groceries'
  WHEN direction = 'debit' AND (contains({h}, 'hpcl') OR contains({h}, 'petrol pump')) THEN 'Fuel' WHEN direction = 'debit' AND contains({h}, 'netflix') THEN 'Subscriptions'
  WHEN direction = 'debit' AND contains({h}, 'uber') THEN 'Transport' WHEN direction = 'credit' AND contains({h}, 'refund') THEN 'Refunds & Cashback' WHEN contains({h}, 'upi/dr') THEN 'Transfers'
  WHEN direction = 'credit' THEN 'Other Income' ELSE 'Other' END"""


TEXT = "lower(coalesce(merchant, '') || ' ' || coalesce(raw_body, ''))"


@query("keyword_category", sql(f"SELECT id, {keyword_sql('h')} AS category FROM (SELECT id, direction, {TEXT} AS h FROM transactions)"))
def keyword_category(spark, sf_dir):
    text = F.lower(F.concat(F.coalesce("merchant", F.lit("")), F.lit(" "), F.coalesce("raw_body", F.lit(""))))
    return v.transactions(spark, sf_dir).select("id", rules.keyword_category(text, F.col("direction"), v.KEYWORDS).alias("category"))


@query(
    "keyword_category_table",
    sql(f"""SELECT t.id, coalesce(k.category, CASE WHEN direction = 'credit' THEN 'Other Income' ELSE 'Other' END) AS category FROM transactions t LEFT JOIN (
  SELECT id, first(category ORDER BY list_place, category) AS category FROM (SELECT t.id, k.category, k.list_place FROM (SELECT id, direction, {TEXT} AS h FROM transactions) t
    JOIN (SELECT w.keyword, w.category, min(w.place) OVER (PARTITION BY w.category) AS list_place, c.kind FROM keyword_table w JOIN categories c ON c.name = w.category) k
    ON contains(t.h, k.keyword) AND CASE WHEN k.category IN {tuple(cat.INCOME_ONLY)} THEN t.direction = 'credit' WHEN k.category IN {tuple(cat.INCOME)} THEN TRUE ELSE t.direction = 'debit' END) GROUP BY 1) k ON k.id = t.id"""),
)
def keyword_category_table(spark, sf_dir):
    """Some hundreds of keywords in 40 lists, read from a table: lists in their order, those for income alone, and those for both."""
    text = F.lower(F.concat(F.coalesce("merchant", F.lit("")), F.lit(" "), F.coalesce("raw_body", F.lit(""))))
    lists = rules.keywords_of(v.keyword_table(spark, sf_dir))
    return v.transactions(spark, sf_dir).select("id", rules.keyword_category(text, F.col("direction"), lists).alias("category"))


@query("suggest_category", sql(f"SELECT id, coalesce(rule_category, {keyword_sql('h')}) AS suggested FROM (SELECT *, {TEXT} AS h FROM ruled)", *HITS))
def suggest_category(spark, sf_dir):
    return rules.suggest_category(v.transactions(spark, sf_dir), v.category_rules(spark), v.KEYWORDS).select("id", "suggested")


@query("apply_rules_dry_run", sql("SELECT count(*) AS examined, CAST(coalesce(sum(CASE WHEN rule_category <> category THEN 1 ELSE 0 END), 0) AS BIGINT) AS changed FROM ruled WHERE status = 'pending'", *HITS))
def apply_rules_dry_run(spark, sf_dir):
    return rules.apply_rules_dry_run(v.transactions(spark, sf_dir), v.category_rules(spark))


@query("apply_rules", sql("SELECT user_id, id, category, rule_category AS new_category FROM ruled WHERE rule_category <> category", *HITS))
def apply_rules(spark, sf_dir):
    return rules.apply_rules(v.transactions(spark, sf_dir), v.category_rules(spark), include_confirmed=True)


@query(
    "learn_rules",
    sql("""SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.pattern, o.pattern) AS pattern, coalesce(n.category, o.category) AS category, coalesce(o.hits, 0) + coalesce(n.n, 0) AS hits
FROM (SELECT user_id, lower(trim(merchant)) AS pattern, first(category ORDER BY occurred_at_ms DESC, category DESC) AS category, count(*) AS n FROM transactions WHERE status = 'confirmed' AND length(trim(merchant)) >= 3 GROUP BY 1, 2) n
FULL JOIN (SELECT * FROM category_rules WHERE origin = 'learned' AND field = 'any' AND match_type = 'contains' AND user_id IS NOT NULL) o ON n.user_id = o.user_id AND n.pattern = o.pattern"""),
)
def learn_rules(spark, sf_dir):
    corrections = v.transactions(spark, sf_dir).filter("status = 'confirmed'").select("user_id", "merchant", "category", F.col("occurred_at_ms").alias("at"))
    return rules.learn_rules(corrections, v.category_rules(spark).filter("user_id is not null"))


@query(
    "next_rules",
    sql("""SELECT r.user_id, r.pattern, CASE WHEN n.category IS NOT NULL AND r.origin = 'learned' AND r.field = 'any' AND r.match_type = 'contains' THEN n.category ELSE r.category END AS category, r.field, r.match_type, r.priority, r.enabled, r.origin,
  r.hits + CASE WHEN r.origin = 'learned' AND r.field = 'any' AND r.match_type = 'contains' THEN coalesce(n.n, 0) ELSE 0 END AS hits FROM category_rules r LEFT JOIN learned n ON n.user_id = r.user_id AND n.pattern = r.pattern
UNION ALL SELECT n.user_id, n.pattern, n.category, 'any', 'contains', 100, TRUE, 'learned', n.n FROM learned n
WHERE NOT EXISTS (SELECT 1 FROM category_rules r WHERE r.user_id = n.user_id AND r.pattern = n.pattern AND r.origin = 'learned' AND r.field = 'any' AND r.match_type = 'contains')""",
        "learned AS (SELECT user_id, lower(trim(merchant)) AS pattern, first(category ORDER BY occurred_at_ms DESC, category DESC) AS category, count(*) AS n FROM transactions WHERE status = 'confirmed' AND length(trim(merchant)) >= 3 GROUP BY 1, 2)"),
)
def next_rules(spark, sf_dir):
    """The whole rules table after all corrections: learned ones updated or added, all others as they were."""
    corrections = v.transactions(spark, sf_dir).filter("status = 'confirmed'").select("user_id", "merchant", "category", F.col("occurred_at_ms").alias("at"))
    return rules.next_rules(v.category_rules(spark), corrections).select("user_id", "pattern", "category", "field", "match_type", "priority", "enabled", "origin", "hits")


@query("rules_ordered", sql("SELECT r.id, r.category, CAST(row_number() OVER (ORDER BY priority, hits DESC, r.id) AS INTEGER) AS place, u.n FROM category_rules r JOIN (SELECT category, count(*) AS n FROM transactions GROUP BY 1) u USING (category)"))
def rules_ordered(spark, sf_dir):
    from pyspark.sql import Window as W

    used = v.transactions(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"))
    listed = rules.rules_ordered(v.category_rules(spark).join(used, "category"))
    return listed.withColumn("place", F.row_number().over(W.orderBy("priority", F.desc("hits"), "id"))).select("id", "category", "place", "n")


# --- periods and history

DAY_SQL = "CAST(make_timestamp(occurred_at_ms * 1000) AS DATE)"
MS = lambda d: f"epoch_us(CAST({d} AS TIMESTAMP)) // 1000"
MONTH_SQL = f"date_trunc('month', {DAY_SQL})"
NOW = datetime(1998, 8, 3, 15, 30)


def cycle_sql(day: str, k: int) -> str:
    on = lambda first: f"({first} + (least({k}, day(last_day({first}))) - 1) * INTERVAL 1 DAY)"
    this, last = f"date_trunc('month', {day})", f"(date_trunc('month', {day}) - INTERVAL 1 MONTH)"
    return f"CAST(CASE WHEN {day} >= {on(this)} THEN {on(this)} ELSE {on(last)} END AS DATE)"


@query("cycle_start", sql(f"SELECT id, {MS(cycle_sql(DAY_SQL, 31))} AS start31_ms, {MS(cycle_sql(DAY_SQL, 7))} AS start7_ms FROM transactions"))
def cycle_start(spark, sf_dir):
    day = day_of(F.col("occurred_at_ms"))
    return v.transactions(spark, sf_dir).select("id", *[ms_of(periods.cycle_start(day, k)).alias(f"start{k}_ms") for k in (31, 7)])


@query(
    "period_range",
    sql("""SELECT period, count(t.id) AS n, CAST(coalesce(sum(amount_paise), 0) AS BIGINT) AS total FROM (VALUES ('Day', DATE '1998-08-03', DATE '1998-08-04'), ('Week', DATE '1998-08-03', DATE '1998-08-10'), ('Month', DATE '1998-07-07', DATE '1998-08-07'),
  ('Pick month', DATE '1998-02-07', DATE '1998-03-07'), ('Year', DATE '1998-01-01', DATE '1999-01-01'), ('All', DATE '1900-01-01', DATE '2200-01-01'), ('Custom', DATE '1998-03-01', DATE '1998-04-16')) p(period, a, b)
JOIN transactions t ON make_timestamp(occurred_at_ms * 1000) >= a AND make_timestamp(occurred_at_ms * 1000) < b GROUP BY 1"""),
)
def period_range(spark, sf_dir):
    told = []
    for p in periods.PERIODS:
        custom = (date(1998, 4, 15), date(1998, 3, 1)) if p == "Custom" else (None, None)
        test = ledger.in_range(F.col("occurred_at_ms"), *periods.period_range(p, NOW, *custom, date(1998, 2, 20) if p == "Pick month" else None, 7))
        told.append(F.struct(F.lit(p).alias("period"), F.count(F.when(test, 1)).alias("n"), F.coalesce(F.sum(F.when(test, F.col("amount_paise"))), F.lit(0)).alias("total")))
    return v.transactions(spark, sf_dir).agg(F.array(*told).alias("p")).select(F.inline("p")).filter("n > 0")


@query(
    "recent_months",
    sql(f"""SELECT back, {MS("m")} AS month_ms, count(t.id) AS n FROM (SELECT CAST(i AS INTEGER) AS back, DATE '1998-08-01' - i * INTERVAL 1 MONTH AS m FROM (SELECT unnest(range(0, 12)) AS i))
LEFT JOIN transactions t ON date_trunc('month', {DAY_SQL}) = m GROUP BY 1, 2"""),
)
def recent_months(spark, sf_dir):
    counts = v.transactions(spark, sf_dir).groupBy(ms_of(F.trunc(day_of(F.col("occurred_at_ms")), "month")).alias("month_ms")).agg(F.count("*").alias("n"))
    return periods.recent_months(spark, NOW.date()).join(counts, "month_ms", "left").select("back", "month_ms", F.coalesce("n", F.lit(0)).alias("n"))


START, END = 820454400000, 946684800000  # 1996 to 1999
FILTERED = f"""filtered AS (SELECT * FROM transactions WHERE status = 'confirmed' AND (title ILIKE '%w_g%' OR merchant ILIKE '%w_g%' OR category ILIKE '%w_g%') AND raw_sender LIKE 'statement:%'
  AND occurred_at_ms >= {START} AND occurred_at_ms < {END} AND category IN ('Rent', 'Groceries', 'Transfers'))"""


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.history_filter(v.transactions(spark, sf_dir), " w_g ", "statement", START, END, ["Rent", "Groceries", "Transfers"])


@query("history_filter", sql("SELECT id, user_id, category, amount_paise FROM filtered", FILTERED))
def history_filter(spark, sf_dir):
    return filtered(spark, sf_dir).select("id", "user_id", "category", "amount_paise")


PLACED = "CAST(row_number() OVER (PARTITION BY user_id ORDER BY occurred_at_ms DESC, id DESC) AS INTEGER) AS row_no"


@query("history_search", sql("""SELECT id, user_id, title FROM (SELECT id, user_id, status, CASE id % 5 WHEN 0 THEN 'a\\b ' || id WHEN 1 THEN 'A\\B' WHEN 2 THEN 'É ' || id WHEN 3 THEN 'é\\' ELSE 'ab' END AS title FROM transactions)
WHERE status = 'confirmed' AND (contains(lower(title), 'a\\b') OR contains(title, 'é'))"""))
def history_search(spark, sf_dir):
    """Searches are text but for % and _: a backslash is one, and only A to Z are alike in both cases."""
    titled = v.transactions(spark, sf_dir).withColumn("title", v.one_of(F.col("id") % 5, ["a\\b ", "A\\B", "É ", "é\\", "ab"])).withColumn("title", F.when(F.col("id") % 5 % 2 == 0, F.concat("title", F.when(F.col("id") % 5 < 4, F.col("id").cast("string")).otherwise(""))).otherwise(F.col("title")))
    found = ledger.history_filter(titled, "a\\b").unionByName(ledger.history_filter(titled, "é"))
    return found.select("id", "user_id", "title").distinct()


@query("history_page", sql(f"SELECT t.id, t.user_id, a.name AS account_name, row_no FROM (SELECT *, {PLACED} FROM transactions WHERE status = 'confirmed') t LEFT JOIN accounts a ON a.id = t.account_id AND a.user_id = t.user_id WHERE row_no > 10 AND row_no <= 60"))
def history_page(spark, sf_dir):
    page = ledger.history_page(ledger.history_filter(v.transactions(spark, sf_dir)), 50, 10)
    return ac.txn_with_account(page, v.accounts(spark, sf_dir)).select("id", "user_id", "account_name", "row_no")


@query("history_ids", sql("SELECT id FROM filtered", FILTERED))
def history_ids(spark, sf_dir):
    return filtered(spark, sf_dir).select("id")


@query("history_by_month", sql(f"SELECT user_id, {MS(MONTH_SQL)} AS month_ms, count(*) AS n, max(occurred_at_ms) AS newest_ms, CAST(sum(amount_paise) AS BIGINT) AS total_paise FROM transactions WHERE status = 'confirmed' GROUP BY 1, 2"))
def history_by_month(spark, sf_dir):
    return ledger.history_by_month(ledger.history_filter(v.transactions(spark, sf_dir)))


@query("pending_list", sql(f"SELECT id, user_id, {PLACED} FROM transactions WHERE status = 'pending'"))
def pending_list(spark, sf_dir):
    rows = ledger.pending(v.transactions(spark, sf_dir))
    return rows.select("id", "user_id", F.row_number().over(ledger.newest(rows)).alias("row_no"))


@query("pending_count", sql("SELECT user_id, count(*) AS pending FROM transactions WHERE status = 'pending' GROUP BY 1"))
def pending_count(spark, sf_dir):
    return ledger.pending(v.transactions(spark, sf_dir)).groupBy("user_id").agg(F.count("*").alias("pending"))


# --- totals

FULL = """lent AS (SELECT user_id, transaction_id AS id, CAST(sum(amount_paise) AS BIGINT) AS lent_paise FROM splits WHERE direction = 'owed_to_me' GROUP BY 1, 2),
full_rows AS (SELECT t.*, coalesce(lent_paise, 0) AS lent_paise, t.category IN (SELECT name FROM categories WHERE money_moved) OR (t.category = 'Rent' AND t.user_id % 4 = 0) AS moved FROM transactions t LEFT JOIN lent ON lent.id = t.id AND lent.user_id = t.user_id)"""
TOTALS = """count(*) AS n, CAST(sum(CASE WHEN direction = 'debit' AND NOT moved THEN amount_paise - lent_paise ELSE 0 END) AS BIGINT) AS spent,
  CAST(sum(CASE WHEN direction = 'credit' AND NOT moved THEN amount_paise ELSE 0 END) AS BIGINT) AS earned, CAST(sum(CASE WHEN direction = 'debit' AND moved THEN amount_paise ELSE 0 END) AS BIGINT) AS moved_paise,
  CAST(sum(CASE WHEN direction = 'debit' THEN lent_paise ELSE 0 END) AS BIGINT) AS lent"""
RANGE = f"status = 'confirmed' AND occurred_at_ms >= {START} AND occurred_at_ms < {END}"
SPENT = f"{RANGE} AND direction = 'debit' AND NOT moved"


def full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.with_lent(v.transactions(spark, sf_dir), v.splits(spark, sf_dir), v.categories(spark, sf_dir))


@query("lent_per_txn", sql("SELECT * FROM lent", FULL))
def lent_per_txn(spark, sf_dir):
    return ledger.lent_per_txn(v.splits(spark, sf_dir))


@query("totals", sql(f"SELECT {TOTALS} FROM full_rows", FULL))
def totals(spark, sf_dir):
    return full_rows(spark, sf_dir).agg(*ledger.totals())


@query("history_summary", sql(f"SELECT user_id, {TOTALS} FROM full_rows WHERE id IN (SELECT id FROM filtered) GROUP BY 1", FILTERED, FULL))
def history_summary(spark, sf_dir):
    return ledger.with_lent(filtered(spark, sf_dir), v.splits(spark, sf_dir), v.categories(spark, sf_dir)).groupBy("user_id").agg(*ledger.totals())


@query("range_summary", sql(f"SELECT *, earned - spent AS net FROM (SELECT user_id, {TOTALS} FROM full_rows WHERE {RANGE} GROUP BY 1)", FULL))
def range_summary(spark, sf_dir):
    return ledger.range_summary(full_rows(spark, sf_dir), START, END)


@query("by_category", sql(f"SELECT *, total / max(total) OVER (PARTITION BY user_id) AS share FROM (SELECT user_id, category, CAST(sum(amount_paise - lent_paise) AS BIGINT) AS total FROM full_rows WHERE {SPENT} GROUP BY 1, 2)", FULL))
def by_category(spark, sf_dir):
    return ledger.by_category(full_rows(spark, sf_dir), START, END)


@query("by_account", sql(f"SELECT t.user_id, a.name AS account_name, CAST(sum(amount_paise - lent_paise) AS BIGINT) AS total FROM full_rows t LEFT JOIN accounts a ON a.id = t.account_id AND a.user_id = t.user_id WHERE {SPENT} GROUP BY 1, 2", FULL))
def by_account(spark, sf_dir):
    return ledger.by_account(full_rows(spark, sf_dir), v.accounts(spark, sf_dir), START, END)


@query(
    "summary_cube",
    sql(f"""SELECT user_id, 'user' AS level, NULL AS name, {TOTALS} FROM full_rows WHERE status = 'confirmed' GROUP BY 1
UNION ALL SELECT user_id, 'category', category, {TOTALS} FROM full_rows WHERE status = 'confirmed' GROUP BY 1, 3
UNION ALL SELECT t.user_id, 'account', a.name, {TOTALS} FROM full_rows t LEFT JOIN accounts a ON a.id = t.account_id AND a.user_id = t.user_id WHERE status = 'confirmed' GROUP BY 1, 3""", FULL),
)
def summary_cube(spark, sf_dir):
    return ledger.summary_cube(full_rows(spark, sf_dir), v.accounts(spark, sf_dir))


@query(
    "summary_by_period",
    sql(f"""SELECT user_id, period, {MS("s")} AS start_ms, {TOTALS} FROM (SELECT *, 'day' AS period, {DAY_SQL} AS s FROM full_rows UNION ALL SELECT *, 'week', date_trunc('week', {DAY_SQL}) FROM full_rows
  UNION ALL SELECT *, 'cycle', {cycle_sql(DAY_SQL, 7)} FROM full_rows UNION ALL SELECT *, 'year', date_trunc('year', {DAY_SQL}) FROM full_rows) WHERE status = 'confirmed' GROUP BY 1, 2, 3""", FULL),
)
def summary_by_period(spark, sf_dir):
    return ledger.summary_by_period(full_rows(spark, sf_dir), 7)


@query(
    "running_totals",
    sql(f"""SELECT user_id, day_ms, n, spent, earned, CAST(sum(spent) OVER (PARTITION BY user_id, date_trunc('month', d) ORDER BY day_ms) AS BIGINT) AS month_spent, CAST(sum(earned) OVER (PARTITION BY user_id, date_trunc('month', d) ORDER BY day_ms) AS BIGINT) AS month_earned,
  CAST(sum(spent) OVER (PARTITION BY user_id ORDER BY day_ms) AS BIGINT) AS ever_spent, CAST(sum(earned) OVER (PARTITION BY user_id ORDER BY day_ms) AS BIGINT) AS ever_earned
FROM (SELECT user_id, {DAY_SQL} AS d, {MS(DAY_SQL)} AS day_ms, {TOTALS} FROM full_rows WHERE status = 'confirmed' GROUP BY 1, 2, 3)""", FULL),
)
def running_totals(spark, sf_dir):
    return ledger.running_totals(full_rows(spark, sf_dir))


@query("category_usage", sql("SELECT user_id, category, count(*) FILTER (WHERE t) AS transactions, count(*) FILTER (WHERE NOT t) AS rules FROM (SELECT user_id, category, TRUE AS t FROM transactions UNION ALL SELECT user_id, category, FALSE FROM category_rules) GROUP BY 1, 2"))
def category_usage(spark, sf_dir):
    return ledger.category_usage(v.transactions(spark, sf_dir), v.category_rules(spark))


@query(
    "deletable_categories",
    sql("""SELECT CAST(NULL AS BIGINT) AS user_id, name FROM categories WHERE name NOT IN (SELECT category FROM transactions) AND name NOT IN (SELECT category FROM category_rules)
UNION ALL SELECT user_id, name FROM (SELECT DISTINCT user_id, n AS name FROM accounts, (VALUES ('Salary'), ('Hobby'), ('Shopping')) x(n)) o
WHERE NOT EXISTS (SELECT 1 FROM transactions t WHERE t.user_id = o.user_id AND t.category = o.name) AND NOT EXISTS (SELECT 1 FROM category_rules r WHERE (r.user_id IS NULL OR r.user_id = o.user_id) AND r.category = o.name)"""),
)
def deletable_categories(spark, sf_dir):
    own = v.accounts(spark, sf_dir).select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, ("Salary", "Hobby", "Shopping")))).alias("name"))
    every = cat.seed_categories(spark).select("user_id", "name").unionByName(own)
    return ledger.deletable_categories(every, v.transactions(spark, sf_dir), v.category_rules(spark))


@query(
    "ledger_upsert",
    sql("""SELECT user_id, id, category, dedup_key FROM (
  SELECT user_id, id, CASE WHEN id % 11 = 0 THEN 'Moved' ELSE category END AS category, dedup_key FROM transactions WHERE id % 13 <> 0
  UNION ALL SELECT user_id, min(id) + 1000000000, first(category ORDER BY id), 'new|' || id // 3 FROM transactions WHERE id % 5 = 0 GROUP BY user_id, id // 3
  UNION ALL SELECT user_id, id + 2000000000, category, dedup_key FROM transactions WHERE id % 13 = 0 AND id % 2 = 0)"""),
)
def ledger_upsert(spark, sf_dir):
    held = v.transactions(spark, sf_dir).select("user_id", "id", "category", "dedup_key")
    fresh = held.filter("id % 5 = 0").select("user_id", (F.col("id") + 1000000000).alias("id"), "category", F.concat(F.lit("new|"), F.expr("id div 3")).alias("dedup_key"))
    again = held.filter("id % 2 = 0").withColumn("id", F.col("id") + 2000000000)  # known keys, but for those deleted
    updates = held.filter("id % 11 = 0").select("user_id", "id", F.lit("Moved").alias("category"))
    return ledger.upsert(held, fresh.unionByName(again), updates, held.filter("id % 13 = 0"))


@query(
    "ledger_store",
    sql("""SELECT user_id, id, category, dedup_key, occurred_at_ms FROM (
  SELECT user_id, id, CASE WHEN id % 11 = 0 AND user_id % 7 = 2 THEN 'Moved' ELSE category END AS category, dedup_key, CASE WHEN id % 11 = 0 AND user_id % 7 = 2 THEN occurred_at_ms + 3000000000 ELSE occurred_at_ms END AS occurred_at_ms
    FROM transactions WHERE id % 13 <> 0 OR user_id % 7 <> 1
  UNION ALL SELECT user_id, id + 2000000000, category, dedup_key, occurred_at_ms + 1 FROM transactions WHERE id % 13 = 0 AND id % 2 = 0 AND user_id % 7 = 1)"""),
)
def ledger_store(spark, sf_dir):
    """The ledger on disk: written, then changed twice for some users each, by partitions; the last version as read."""
    held = v.transactions(spark, sf_dir).select("user_id", "id", "category", "dedup_key", "occurred_at_ms")
    kept = store.LedgerStore(spark, shared_path(spark, "ledger"), 3)
    kept.write(held)
    own = held.filter("user_id % 7 = 1")
    again = own.filter("id % 2 = 0").withColumn("id", F.col("id") + 2000000000).withColumn("occurred_at_ms", F.col("occurred_at_ms") + 1)  # known keys, but for those deleted
    kept.upsert(again, None, own.filter("id % 13 = 0"))
    moved = held.filter("user_id % 7 = 2 and id % 11 = 0").select("user_id", "id", F.lit("Moved").alias("category"), (F.col("occurred_at_ms") + 3000000000).alias("occurred_at_ms"))
    kept.upsert(held.limit(0), moved)
    return kept.read()


# --- splits


@query("even_shares", sql("SELECT id, CAST(amount_paise // n + CASE WHEN i < amount_paise % n THEN 1 ELSE 0 END AS BIGINT) AS share, CAST(i AS INTEGER) AS i FROM (SELECT id, amount_paise, id % 7 AS n, unnest(range(0, id % 7)) AS i FROM transactions)"))
def even_shares(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", F.posexplode(sp.even_shares(F.col("amount_paise"), F.col("id") % 7)).alias("i", "share"))


EVEN = "SELECT id, person_id, CAST(amount_paise // (n + 1) + CASE WHEN i + 1 < amount_paise % (n + 1) THEN 1 ELSE 0 END AS BIGINT) AS share_paise FROM"


@query("split_evenly_with_me", sql(f"{EVEN} (SELECT id, amount_paise, id % 4 AS n, i, 10 + i AS person_id FROM (SELECT *, unnest(range(0, id % 4)) AS i FROM transactions))"))
def split_evenly_with_me(spark, sf_dir):
    people = F.when(F.col("id") % 4 > 0, F.sequence(F.lit(10).cast("long"), 9 + F.col("id") % 4)).otherwise(F.array().cast("array<bigint>"))
    return v.transactions(spark, sf_dir).select("id", F.inline(sp.split_evenly_with_me(F.col("amount_paise"), people)))


@query("toggle_share", sql(f"{EVEN} (SELECT id, amount_paise, len(ps) AS n, unnest(range(0, len(ps))) AS i, unnest(ps) AS person_id FROM (SELECT id, amount_paise, CASE id % 4 WHEN 0 THEN [2, 3] WHEN 1 THEN [1, 3] WHEN 2 THEN [1, 2] ELSE [1, 2, 3, 4] END AS ps FROM transactions))"))
def toggle_share(spark, sf_dir):
    people = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    return v.transactions(spark, sf_dir).select("id", F.inline(sp.toggle_share(people, F.col("id") % 4 + 1, F.col("amount_paise")))).select("id", F.col("person_id").cast("int").alias("person_id"), "share_paise")


@query("my_share", sql("SELECT id, greatest(0, amount_paise // 1000 - lent_paise) AS own_paise FROM full_rows", FULL))
def my_share(spark, sf_dir):
    return full_rows(spark, sf_dir).select("id", sp.my_share(F.expr("amount_paise div 1000"), F.col("lent_paise")).alias("own_paise"))


NET = "net AS (SELECT user_id, person_id, CAST(sum(CASE WHEN direction = 'owed_to_me' THEN amount_paise ELSE -amount_paise END) AS BIGINT) AS net_paise FROM splits WHERE settled_at_ms IS NULL GROUP BY 1, 2 HAVING net_paise <> 0)"


@query("outstanding_balances", sql("SELECT * FROM net", NET))
def outstanding_balances(spark, sf_dir):
    return sp.outstanding_balances(v.splits(spark, sf_dir))


@query("total_outstanding", sql("SELECT user_id, CAST(sum(greatest(net_paise, 0)) AS BIGINT) AS owed_to_me, CAST(sum(greatest(-net_paise, 0)) AS BIGINT) AS i_owe FROM net GROUP BY 1", NET))
def total_outstanding(spark, sf_dir):
    return sp.total_outstanding(v.splits(spark, sf_dir))


@query(
    "replace_splits",
    sql("""SELECT user_id, transaction_id, person_id, amount_paise, direction, settled_at_ms FROM splits WHERE transaction_id % 5 <> 0
UNION ALL SELECT n.user_id, n.transaction_id, n.person_id, n.amount_paise, n.direction, w.settled_at_ms FROM (SELECT DISTINCT user_id, transaction_id, person_id, direction, transaction_id % 1000 AS amount_paise FROM splits WHERE transaction_id % 5 = 0 AND transaction_id % 1000 > 0) n
LEFT JOIN (SELECT user_id, transaction_id, person_id, direction, max(settled_at_ms) AS settled_at_ms FROM splits GROUP BY 1, 2, 3, 4) w USING (user_id, transaction_id, person_id, direction)"""),
)
def replace_splits(spark, sf_dir):
    held = v.splits(spark, sf_dir)
    new = held.filter("transaction_id % 5 = 0").select("user_id", "transaction_id", "person_id", "direction", (F.col("transaction_id") % 1000).alias("amount_paise")).distinct()
    return sp.replace_splits(held, new)


@query("settle_up", sql("SELECT user_id, transaction_id, person_id, amount_paise, direction, coalesce(settled_at_ms, CASE WHEN person_id % 3 = 0 THEN 902158200000 END) AS settled_at_ms FROM splits"))
def settle_up(spark, sf_dir):
    held = v.splits(spark, sf_dir)
    return sp.settle_up(held, held.filter("person_id % 3 = 0"), 902158200000).select(*held.columns)


@query("split_with_person", sql("SELECT s.user_id, transaction_id, person_id, amount_paise, direction, settled_at_ms, p.name AS person_name FROM splits s JOIN people p ON p.id = s.person_id AND p.user_id = s.user_id"))
def split_with_person(spark, sf_dir):
    return sp.split_with_person(v.splits(spark, sf_dir), v.people(spark, sf_dir))


@query("deletable_people", sql("SELECT * FROM people p WHERE NOT EXISTS (SELECT 1 FROM splits s WHERE s.settled_at_ms IS NULL AND s.user_id = p.user_id AND s.person_id = p.id)"))
def deletable_people(spark, sf_dir):
    return sp.deletable_people(v.people(spark, sf_dir), v.splits(spark, sf_dir))


# --- categories


@query("normalize_name", sql("SELECT id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS name FROM (SELECT c_custkey AS id, '  ' || c_name || chr(9) || '  x ' AS name FROM customer)"))
def normalize_name(spark, sf_dir):
    raw = F.concat(F.lit("  "), F.col("c_name"), F.lit("\t  x "))
    return v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cat.normalize_name(raw).alias("name"))


RENAMES = """renames AS (SELECT user_id, o AS old_name, n AS new_name FROM (SELECT DISTINCT user_id FROM accounts),
  (VALUES ('Rent', 'House Rent', 1), ('Salary', 'Pay', 2), ('Groceries', 'fuel', 3), ('Transfers', 'Moved A', 5), ('Transfers', 'Moved B', 5)) x(o, n, k) WHERE user_id % k = 0)"""


def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: a name with white space to tidy, a plain one, one that clashes with a category, and a name renamed twice."""
    asked = [("Rent", " House   Rent ", 1), ("Salary", "Pay", 2), ("Groceries", "fuel", 3), ("Transfers", "Moved A", 5), ("Transfers", "Moved B", 5)]
    made = F.explode(F.array(*[F.struct(F.lit(o).alias("old_name"), F.lit(n).alias("new_name"), F.lit(k).alias("k")) for o, n, k in asked])).alias("r")
    return v.accounts(spark, sf_dir).select("user_id").distinct().select("user_id", made).filter("user_id % r.k = 0").select("user_id", "r.old_name", "r.new_name")


@query("rename_categories", sql("SELECT id, user_id, CASE WHEN category = 'Rent' THEN 'House Rent' WHEN category = 'Salary' AND user_id % 2 = 0 THEN 'Pay' ELSE category END AS category FROM transactions"))
def rename_categories(spark, sf_dir):
    return cat.rename_categories(v.transactions(spark, sf_dir).select("id", "user_id", "category"), renames(spark, sf_dir), v.categories(spark, sf_dir))


@query("judged_renames", sql("SELECT *, CASE old_name WHEN 'Groceries' THEN 'clash' WHEN 'Transfers' THEN 'repeated' END AS reason FROM renames", RENAMES))
def judged_renames(spark, sf_dir):
    return cat.judged_renames(renames(spark, sf_dir), v.categories(spark, sf_dir))


@query("rename_counts", sql("""SELECT DISTINCT r.user_id, old_name, (SELECT count(*) FROM transactions t WHERE t.user_id = r.user_id AND t.category = old_name) AS transactions,
  (SELECT count(*) FROM category_rules c WHERE c.user_id = r.user_id AND c.category = old_name) AS rules FROM renames r""", RENAMES))
def rename_counts(spark, sf_dir):
    return cat.rename_counts(v.transactions(spark, sf_dir), v.category_rules(spark), renames(spark, sf_dir))


@query("categories_for_direction", sql("SELECT t.id, c.name FROM categories c JOIN transactions t ON t.category = c.name AND t.direction = 'credit' WHERE c.kind IN ('income', 'both')"))
def categories_for_direction(spark, sf_dir):
    fits = cat.categories_for_direction(cat.seed_categories(spark), "credit")
    return v.transactions(spark, sf_dir).filter("direction = 'credit'").join(fits.withColumnRenamed("name", "category"), "category").select("id", F.col("category").alias("name"))


@query("seed_categories", sql("SELECT c.name, c.kind, c.money_moved, count(t.id) AS n FROM categories c LEFT JOIN transactions t ON t.category = c.name GROUP BY 1, 2, 3"))
def seed_categories(spark, sf_dir):
    used = v.transactions(spark, sf_dir).groupBy(F.col("category").alias("name")).agg(F.count("*").alias("n"))
    return cat.seed_categories(spark).join(used, "name", "left").select("name", "kind", "money_moved", F.coalesce("n", F.lit(0)).alias("n"))


@query("orphan_categories", sql("SELECT DISTINCT category || CASE WHEN id % 3 = 0 THEN ' old' ELSE '' END AS name, 'both' AS kind, user_id FROM transactions WHERE id % 3 = 0"))
def orphan_categories(spark, sf_dir):
    rows = v.transactions(spark, sf_dir).withColumn("category", F.when(F.col("id") % 3 == 0, F.concat(F.col("category"), F.lit(" old"))).otherwise(F.col("category")))
    return cat.orphan_categories(rows, v.categories(spark, sf_dir))


# --- snapshots


def user_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    txn = v.transactions(spark, sf_dir)
    users = txn.select("user_id").distinct()
    own = v.category_rules(spark).filter("user_id is not null")
    persons = v.people(spark, sf_dir).select("user_id", "id", "name")
    tables = {"accounts": v.accounts(spark, sf_dir), "transactions": txn, "category_rules": own, "splits": v.splits(spark, sf_dir), "people": persons}
    return tables | {"categories": users.withColumn("c", F.explode(F.array(*[F.struct(F.lit(r[0]).cast("long").alias("id"), F.lit(r[1]).alias("name")) for r in cat.seed_rows()]))).select("user_id", "c.id", "c.name")}


COUNTS = """(SELECT user_id, count(*) AS transactions, md5(string_agg(concat_ws(':', id, amount_paise, direction, category, occurred_at_ms, coalesce(merchant, '-'), coalesce(reference, '-')), ',' ORDER BY id)) AS digest FROM transactions GROUP BY 1) t
LEFT JOIN (SELECT user_id, count(*) AS splits FROM splits GROUP BY 1) s USING (user_id) LEFT JOIN (SELECT user_id, count(*) AS accounts FROM accounts GROUP BY 1) a USING (user_id)"""


@query("snapshot_export", sql(f"SELECT user_id, transactions, coalesce(splits, 0) AS splits, coalesce(accounts, 0) AS accounts, 40 AS categories, 8 AS schema_version, 'ledger-snapshot' AS format, '2026-01-01T00:00:00Z' AS exported_at, digest FROM {COUNTS}"))
def snapshot_export(spark, sf_dir):
    doc = snap.snapshot_export(user_tables(spark, sf_dir), "2026-01-01T00:00:00Z")
    shape = F.from_json("document", "format string, exportedAt string, schemaVersion int, transactions array<struct<id: long, amount_paise: long, direction: string, category: string, occurred_at_ms: long, merchant: string, reference: string>>, splits array<struct<person_id: long>>, accounts array<struct<id: long>>, categories array<struct<id: long>>").alias("d")
    n = lambda c: F.size(f"d.{c}")
    said = lambda t: F.concat_ws(":", t["id"], t["amount_paise"], t["direction"], t["category"], t["occurred_at_ms"], F.coalesce(t["merchant"], F.lit("-")), F.coalesce(t["reference"], F.lit("-")))
    digest = F.md5(F.array_join(F.transform("d.transactions", said), ",").cast("binary"))
    return doc.select("user_id", shape).select("user_id", n("transactions").cast("long").alias("transactions"), n("splits").cast("long").alias("splits"), n("accounts").cast("long").alias("accounts"), n("categories").alias("categories"), F.col("d.schemaVersion").alias("schema_version"), "d.format", F.col("d.exportedAt").alias("exported_at"), digest.alias("digest"))


@query("snapshot_restore", sql("SELECT user_id, CASE user_id % 5 WHEN 1 THEN 'newer schema' WHEN 2 THEN 'foreign format' END AS reason, CASE WHEN user_id % 5 NOT IN (1, 2) THEN count(*) END AS transactions, CASE WHEN user_id % 5 NOT IN (1, 2) THEN CAST(sum(amount_paise) AS BIGINT) END AS total_paise FROM transactions GROUP BY 1"))
def snapshot_restore(spark, sf_dir):
    doc = snap.snapshot_export(user_tables(spark, sf_dir), "2026-01-01T00:00:00Z")
    kind = F.col("user_id") % 5
    doc = doc.withColumn("document", F.when(kind == 1, F.regexp_replace("document", '"schemaVersion":8', '"schemaVersion":9')).when(kind == 2, F.regexp_replace("document", snap.FORMAT, "other")).otherwise(F.col("document")))
    rows, refused = snap.snapshot_restore(doc, {"transactions": "id: long, amount_paise: long"})
    back = rows["transactions"].groupBy("user_id").agg(F.count("*").alias("transactions"), F.sum("amount_paise").alias("total_paise"))
    return back.join(refused, "user_id", "full").select("user_id", "reason", "transactions", "total_paise")


@query(
    "snapshot_parts",
    sql("""SELECT user_id, reason, CASE WHEN reason IS NULL THEN transactions END AS transactions, CASE WHEN reason IS NULL THEN total_paise END AS total_paise, CASE WHEN reason IS NULL THEN coalesce(splits, 0) END AS splits
FROM (SELECT user_id, CASE user_id % 6 WHEN 1 THEN 'newer schema' WHEN 2 THEN 'foreign format' WHEN 3 THEN 'missing part' WHEN 4 THEN CASE WHEN accounts > 0 THEN 'rows without parents' END END AS reason, transactions, total_paise, splits
  FROM (SELECT user_id, count(*) AS transactions, CAST(sum(amount_paise) AS BIGINT) AS total_paise, count(account_id) AS accounts FROM transactions GROUP BY 1) t LEFT JOIN (SELECT user_id, count(*) AS splits FROM splits GROUP BY 1) s USING (user_id))"""),
)
def snapshot_parts(spark, sf_dir):
    """Snapshots in small parts and back: some users' manifests are of others' making, some have lost a part, some were exported without their accounts."""
    tables = user_tables(spark, sf_dir)
    tables["accounts"] = tables["accounts"].filter("user_id % 6 != 4")
    parts, manifests = sparts.export_parts(tables, "2026-01-01T00:00:00Z", 20_000)
    kind = F.col("user_id") % 6
    manifests = manifests.withColumn("schemaVersion", F.when(kind == 1, 9).otherwise(F.col("schemaVersion"))).withColumn("format", F.when(kind == 2, "other").otherwise(F.col("format")))
    hit = F.coalesce((F.col("user_id") % 6 == 3) & (F.col("table") == "transactions"), F.lit(False))
    lost = parts.filter(hit).groupBy("user_id", "table").agg(F.max("part").alias("part"))
    shapes = {"accounts": "id: long", "people": "id: long", "transactions": "id: long, account_id: long, amount_paise: long", "splits": "transaction_id: long, person_id: long"}
    kept = parts.filter(~hit).union(parts.filter(hit).join(lost, ["user_id", "table", "part"], "left_anti"))  # documents that none is lost of don't cross the network
    rows, refused = sparts.restore_parts(kept, manifests, shapes)
    back = rows["transactions"].groupBy("user_id").agg(F.count("*").alias("transactions"), F.sum("amount_paise").alias("total_paise"))
    shared = rows["splits"].groupBy("user_id").agg(F.count("*").alias("splits"))
    out = back.join(shared, "user_id", "left").withColumn("splits", F.coalesce("splits", F.lit(0)))
    return out.join(refused, "user_id", "full").join(tables["transactions"].select("user_id").distinct(), "user_id", "left_semi").select("user_id", "reason", "transactions", "total_paise", "splits")


@query("snapshot_retain", sql("SELECT user_id, id AS snapshot_id, occurred_at_ms AS modified_ms FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at_ms DESC, id DESC) AS n FROM transactions) WHERE n > 10"))
def snapshot_retain(spark, sf_dir):
    kept = v.transactions(spark, sf_dir).select("user_id", F.col("id").alias("snapshot_id"), F.col("occurred_at_ms").alias("modified_ms"))
    return snap.snapshot_retain(kept)


# --- streams: the same rows, written as files and read as a stream


def as_stream(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    path = shared_path(spark, "stream")
    v.captures(spark, sf_dir).write.parquet(f"{path}/in")
    return cap.read_captures(spark, f"{path}/in", stream=True), path


@query("stream_dedup", sql(f"SELECT user_id, source, count(*) AS n, CAST(sum(length(body)) AS BIGINT) AS chars FROM ({PREFILTERED}) GROUP BY 1, 2"))
def stream_dedup(spark, sf_dir):
    """The stream's filter and dedup; the rows it appends are read back from its own output."""
    rows, path = as_stream(spark, sf_dir)
    run = ingest.stream_dedup(rows).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(cap.SCHEMA).parquet(f"{path}/out").groupBy("user_id", "source").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))


def in_two(captures: DataFrame) -> list[DataFrame]:
    """The messages of the first and of the second half of the time, as they would arrive."""
    middle = captures.agg(F.expr("(min(posted_at_ms) + max(posted_at_ms)) div 2")).first()[0]
    first = F.coalesce(F.col("posted_at_ms") < middle, F.lit(True))
    return [captures.filter(first), captures.filter(~first)]


@query("stream_totals", sql("SELECT user_id, direction, occurred_at_ms // 86400000 * 86400000 AS start_ms, count(*) AS n, CAST(sum(amount_paise) AS BIGINT) AS total_paise FROM parsed GROUP BY 1, 2, 3", PARSED))
def stream_totals(spark, sf_dir):
    """Daily totals over two arrivals of messages."""
    path = shared_path(spark, "stream")
    sums = ingest.total_sums(spark, f"{path}/sums")
    for part in in_two(v.captures(spark, sf_dir)):
        part.write.mode("append").parquet(f"{path}/in")
        ingest.stream_totals(cap.read_captures(spark, f"{path}/in", stream=True), sums, f"{path}/cp").awaitTermination()
    return sums.read()


@query("stream_pending_count", sql("SELECT user_id, count(*) AS pending FROM transactions WHERE (status = 'pending' AND id % 14 <> 0 AND id % 5 <> 0) OR (status = 'confirmed' AND id % 15 = 1) GROUP BY 1"))
def stream_pending_count(spark, sf_dir):
    """Rows arrive; then some that wait are confirmed, some go, and some that were confirmed wait again."""
    path, rows = shared_path(spark, "stream"), v.transactions(spark, sf_dir)
    counts, kept = ingest.pending_sums(spark, f"{path}/sums"), rows.select("user_id", "id", "status")
    confirmed, gone, reopened = kept.filter("status = 'pending' and id % 14 = 0"), kept.filter("status = 'pending' and id % 14 != 0 and id % 5 = 0"), kept.filter("status = 'confirmed' and id % 15 = 1")
    none = kept.limit(0)
    changed = signed(confirmed.union(gone).union(reopened), confirmed.withColumn("status", F.lit("confirmed")).union(reopened.withColumn("status", F.lit("pending"))))
    for change in (signed(none, kept), changed):
        change.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("user_id long, id long, status string, sign int").parquet(f"{path}/in")
        ingest.stream_pending_count(stream, counts, f"{path}/cp").awaitTermination()
    return counts.read().select("user_id", F.col("n").alias("pending"))


@query("stream_near_dup", sql("SELECT id, user_id, match_id FROM walk", PARSED, new_sql("came_all", "parsed"), "came AS MATERIALIZED (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS r) FROM came_all)", *walk_sql("walk", "came", "posted_at_ms, id", 600000)))
def stream_near_dup(spark, sf_dir):
    rows, path = as_stream(spark, sf_dir)
    with ingest.with_rocksdb(spark):
        ingest.stream_near_dup(rows).writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema("id long, user_id long, match_id long").parquet(f"{path}/out")


# --- whole flows

ROW = "user_id, dedup_key, amount_paise, direction, merchant, category, status, confidence"
#: Rows accepted from messages, read like a ledger's.
ACCEPTED = "accepted AS MATERIALIZED (SELECT p.*, CAST(NULL AS VARCHAR) AS title, p.body AS raw_body FROM parsed p JOIN taken t ON t.id = p.id AND t.user_id = p.user_id)"
NAMED = f"""named AS (SELECT r.user_id, dedup_key, amount_paise, direction, merchant, coalesce(rule_category, {keyword_sql("h")}) AS category, 'pending' AS status, r.confidence, r.last4, k.account_id
  FROM (SELECT *, {TEXT} AS h FROM ruled) r LEFT JOIN known k ON k.user_id = r.user_id AND k.last4 = r.last4)"""


def blank_ledger(rows: DataFrame) -> DataFrame:
    """Parsed messages as rows of a ledger."""
    none = lambda kind: F.lit(None).cast(kind)
    return rows.select(
        "user_id", "id", none("long").alias("account_id"), "amount_paise", "direction", none("string").alias("title"), "merchant", F.lit("Other").alias("category"), "occurred_at_ms", "source",
        F.lit("confirmed").alias("status"), F.col("sender").alias("raw_sender"), F.col("body").alias("raw_body"), "dedup_key", "reference",
        "confidence", none("string").alias("note"),
    )


DRAINED = (
    PARSED, KNOWN, "drained AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY posted_at_ms DESC, id DESC) AS n FROM captures WHERE id % 5 <> 0) WHERE n <= 200)",
    "old AS MATERIALIZED (SELECT * FROM parsed WHERE id % 5 = 0)", "young AS MATERIALIZED (SELECT * FROM parsed WHERE id IN (SELECT id FROM drained))", led_sql("held", "old"), new_sql("came", "young"),
    by_ref("hit_ref", "came", "held"), by_time("hit_time", "came", "held", 600000),
    "fresh AS MATERIALIZED (SELECT * FROM came c WHERE id NOT IN (SELECT incoming_id FROM hit_ref) AND id NOT IN (SELECT incoming_id FROM hit_time) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.user_id = c.user_id AND h.dedup_key = c.dedup_key))",
    *walk_sql("walk", "fresh", NEWEST, 600000), "taken AS (SELECT id, user_id FROM walk WHERE match_id IS NULL)", ACCEPTED, *hits_sql("accepted"), NAMED,
)


def drained(spark: SparkSession, sf_dir: str) -> flows.Drained:
    captures = v.captures(spark, sf_dir)
    consumed = captures.filter("id % 5 = 0")
    held = written(blank_ledger(messages.parse_captures(consumed)), "ledger")  # read from the messages once
    return flows.drain_batch(captures, consumed, held, v.accounts(spark, sf_dir), v.category_rules(spark), v.KEYWORDS)


@query(
    "drain_batch",
    sql(f"""SELECT {ROW}, coalesce(a.name, CASE WHEN n.last4 IS NOT NULL THEN 'Card ••' || n.last4 END) AS account_name FROM named n LEFT JOIN (SELECT id, name FROM accounts) a ON a.id = n.account_id
UNION ALL SELECT user_id, dedup_key, amount_paise, direction, merchant, 'Other', 'confirmed', confidence, NULL FROM old""", *DRAINED),
)
def drain_batch(spark, sf_dir):
    """From the queue to the next version of the ledger; the messages consumed before are in it already."""
    done = drained(spark, sf_dir)
    return ac.txn_with_account(done.ledger, done.accounts).select(*ROW.split(", "), "account_name")


@query(
    "drain_report",
    sql("SELECT d.user_id, count(t.id) AS imported, count(*) - count(t.id) AS skipped FROM drained d LEFT JOIN taken t ON t.id = d.id AND t.user_id = d.user_id GROUP BY 1", *DRAINED),
)
def drain_report(spark, sf_dir):
    return drained(spark, sf_dir).report


MIDDLE = "middle AS (SELECT (min(posted_at_ms) + max(posted_at_ms)) // 2 AS mid FROM captures)"
STREAMED = (
    PARSED, KNOWN, MIDDLE, f"passed AS MATERIALIZED (SELECT * FROM parsed WHERE id IN (SELECT id FROM ({PREFILTERED})))", "early AS (SELECT * FROM passed WHERE posted_at_ms < (SELECT mid FROM middle))",
    "late AS (SELECT * FROM passed WHERE posted_at_ms >= (SELECT mid FROM middle))", new_sql("came1", "early"), *walk_sql("walk1", "came1", NEWEST, 600000),
    "first AS MATERIALIZED (SELECT p.* FROM passed p JOIN walk1 w ON w.id = p.id WHERE w.match_id IS NULL)", led_sql("held", "first"), new_sql("came2", "late"),
    by_ref("hit_ref", "came2", "held"), by_time("hit_time", "came2", "held", 600000),
    "fresh AS MATERIALIZED (SELECT * FROM came2 WHERE id NOT IN (SELECT incoming_id FROM hit_ref) AND id NOT IN (SELECT incoming_id FROM hit_time))",
    *walk_sql("walk2", "fresh", NEWEST, 600000), "taken AS (SELECT id, user_id FROM first UNION ALL SELECT id, user_id FROM walk2 WHERE match_id IS NULL)", ACCEPTED, *hits_sql("accepted"), NAMED,
)


LEDGER = ["user_id", "id", "dedup_key", "source", "amount_paise", "direction", "merchant", "reference", "occurred_at_ms", "status"]


def live(spark: SparkSession, sf_dir: str, blank: DataFrame, rows_of) -> tuple[DataFrame, str]:
    """The live ingest over two arrivals of messages, each matched by the index that the first has filled: the ledger that it appends to, and where all of it lies."""
    path = shared_path(spark, "stream")
    index = MatchIndex(spark, f"{path}/index", 8)

    def append(rows: DataFrame, i: int) -> DataFrame:
        flows.like_ledger(rows, blank).write.mode("overwrite").parquet(f"{path}/ledger/batch={i}")
        return spark.read.schema(blank.schema).parquet(f"{path}/ledger/batch={i}")

    for part in in_two(v.captures(spark, sf_dir)):
        part.write.mode("append").parquet(f"{path}/in")
        ingest.stream_ingest(cap.read_captures(spark, f"{path}/in", stream=True), f"{path}/cp", append, index, rows_of).awaitTermination()
    index.close()
    return spark.read.schema(blank.schema).parquet(f"{path}/ledger"), path


@query("stream_ledger", sql("SELECT p.user_id, p.id, dedup_key, source, amount_paise, direction, merchant, reference, occurred_at_ms, 'pending' AS status FROM passed p JOIN taken t ON t.id = p.id AND t.user_id = p.user_id", *STREAMED))
def stream_ledger(spark, sf_dir):
    """The rows that the live ingest appends, as parsed."""
    titled = lambda rows: rows.withColumn("title", F.lit(None).cast("string")).withColumn("raw_sender", F.col("sender")).withColumn("status", F.lit("pending"))
    blank = titled(messages.parse_captures(spark.createDataFrame([], cap.SCHEMA)))
    return live(spark, sf_dir, blank, lambda rows, held: titled(flows.ledger_rows(rows, held)))[0].select(*LEDGER)


@query("stream_ingest", sql(f"SELECT {ROW}, account_id FROM named", *STREAMED))
def stream_ingest(spark, sf_dir):
    """The live ingest over two arrivals of messages: filter, exact dedup, parse, match with the ledger, collapse, account, category. The rows it appends, with the account if it was there."""
    blank = blank_ledger(messages.parse_captures(spark.createDataFrame([], cap.SCHEMA)))
    accounts, own_rules = v.accounts(spark, sf_dir), v.category_rules(spark)
    out, _ = live(spark, sf_dir, blank, lambda rows, held: flows.pending_rows(rows, held, accounts, own_rules, v.KEYWORDS)[0])
    known = accounts.select("user_id", F.col("id").alias("account_id"), F.lit(True).alias("known"))
    return out.join(known, ["user_id", "account_id"], "left").withColumn("account_id", F.when(F.col("known"), F.col("account_id"))).select(*ROW.split(", "), "account_id")


@query("index_matches", sql("SELECT f.user_id, f.incoming_id, f.layer, f.ledger_id FROM found f", *BASE, FOUND))
def index_matches(spark, sf_dir):
    """The statement rows against a standing index of the messages' ledger, filled in four parts."""
    index = MatchIndex(spark, shared_path(spark, "index"), 8, 2)
    held = led(spark, sf_dir)
    for i in range(4):
        index.add(held.filter(F.pmod("id", F.lit(4)) == i))
    out = written(index.find_duplicate(inc(spark, sf_dir), 0), "found")
    index.close()
    return out


#: The ledger before statements come: a third of their payments pending and known by reference, a third confirmed and known by time and shop.
BEFORE = """before AS MATERIALIZED (SELECT user_id, id, amount_paise, direction, 'Shop ' || (id % 50) AS merchant, 'k|' || id AS dedup_key, CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'confirmed' END AS status, CAST(0.8 AS DOUBLE) AS confidence FROM transactions WHERE id % 3 <> 2)"""
TAKEN = f"""accepted AS MATERIALIZED (SELECT user_id, id, amount_paise, direction, CAST(NULL AS VARCHAR) AS title, 'Shop ' || (id % 50) AS merchant, 'UPI/SHOP ' || (id % 50) || '/' || (300000000000 + id) || '/x' AS raw_body,
  'stmt|table|' || (300000000000 + id) AS dedup_key, lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS last4, CAST(1.0 AS DOUBLE) AS confidence FROM transactions WHERE id % 9 <> 0 AND id % 3 <> 1)"""


def imported(spark: SparkSession, sf_dir: str) -> flows.Imported:
    txn = v.transactions(spark, sf_dir).filter("id % 3 != 2")
    noon = F.floor(F.col("occurred_at_ms") / 86_400_000) * 86_400_000 + 46_800_000
    held = txn.select(
        "user_id", "id", F.lit(None).cast("long").alias("account_id"), "amount_paise", "direction", F.lit(None).cast("string").alias("title"), F.concat(F.lit("Shop "), F.col("id") % 50).alias("merchant"),
        F.lit("Other").alias("category"), noon.cast("long").alias("occurred_at_ms"), F.lit("sms").alias("source"), F.when(F.col("id") % 3 == 0, "pending").otherwise("confirmed").alias("status"),
        F.lit("HDFCBK").alias("raw_sender"), F.lit(None).cast("string").alias("raw_body"), F.concat(F.lit("k|"), "id").alias("dedup_key"),
        F.when(F.col("id") % 3 == 0, (300000000000 + F.col("id")).cast("string")).alias("reference"), F.lit(0.8).alias("confidence"), F.lit(None).cast("string").alias("note"),
    )
    return flows.import_statements(statement_files(spark, sf_dir), held, v.accounts(spark, sf_dir), v.category_rules(spark), v.KEYWORDS)


@query(
    "import_statements",
    sql(f"""SELECT {ROW}, coalesce(a.name, 'Card ••' || n.last4) AS account_name FROM named n LEFT JOIN (SELECT id, name FROM accounts) a ON a.id = n.account_id
UNION ALL SELECT user_id, dedup_key, amount_paise, direction, merchant, 'Other', status, confidence, NULL FROM before WHERE id % 3 <> 0 OR id % 9 = 0""", KNOWN, BEFORE, TAKEN, *hits_sql("accepted"), NAMED),
)
def import_statements(spark, sf_dir):
    """From whole statement files to the next version of the ledger."""
    done = imported(spark, sf_dir)
    return ac.txn_with_account(done.ledger, done.accounts).select(*ROW.split(", "), "account_name")


@query(
    "statement_report",
    sql("""SELECT user_id, CAST(user_id AS VARCHAR) AS file_id, count(*) FILTER (WHERE id % 9 <> 0 AND id % 3 <> 1) AS imported, count(*) FILTER (WHERE id % 9 <> 0 AND id % 3 = 1) AS duplicates,
  count(*) FILTER (WHERE id % 9 <> 0 AND id % 3 = 0) AS replaced, count(*) FILTER (WHERE id % 9 = 0) AS unparsed FROM transactions GROUP BY 1"""),
)
def statement_report(spark, sf_dir):
    return imported(spark, sf_dir).report
