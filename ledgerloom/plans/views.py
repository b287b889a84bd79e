"""Ledger tables made from the given star-schema and event tables, so every operator has rows in proportion to its input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import DAY_MS, NOON_MS
from ..operators.categories import seed_categories, seed_rows

RULES_SCHEMA = (
    "id long, user_id long, pattern string, category string, field string, match_type string, direction string, min_paise long, max_paise long, priority int,"
    " enabled boolean, origin string, hits long"
)
#: (id, user_id, pattern, category, field, match_type, direction, min_paise, max_paise, priority, enabled, origin, hits): each field, match type, bound and tie.
RULES = [
    (1, None, "swiggy", "Food & Dining", "merchant", "contains", None, None, None, 50, True, "manual", 0),
    (2, None, "swiggy", "Groceries", "any", "contains", None, None, None, 50, True, "learned", 99),
    (3, None, "hpcl", "Fuel", "merchant", "starts_with", "debit", None, None, 10, True, "manual", 0),
    (4, None, "pump", "Transport", "any", "ends_with", "credit", None, None, 20, True, "manual", 0),
    (5, None, "netflix", "Subscriptions", "any", "equals", None, None, None, 30, True, "manual", 0),
    (6, None, "^note 1[0-3]$", "Rent", "title", "regex", None, 100000, None, 5, True, "manual", 0),
    (7, None, "note", "Gifts & Donations", "title", "contains", None, None, 9999999, 40, True, "manual", 3),
    (8, None, "note", "Household", "title", "contains", None, 10000000, None, 40, True, "manual", 3),
    (9, None, "swiggy(", "Broken", "any", "regex", None, None, None, 1, True, "manual", 0),
    (10, None, "", "Empty", "any", "contains", None, None, None, 1, True, "manual", 0),
    (11, None, "blinkit", "Off", "any", "contains", None, None, None, 1, False, "manual", 0),
    (12, 7, "blinkit", "Groceries", "any", "contains", None, None, None, 100, True, "learned", 2),
    (13, 9, "swiggy limited", "Shopping", "merchant", "equals", None, None, None, 1, True, "learned", 5),
]

#: The keyword lists of the household that these tables stand for.
KEYWORDS = {
    "Food & Dining": ["swiggy"], "Groceries": ["blinkit"], "Fuel": ["hpcl", "petrol pump"], "Subscriptions": ["netflix"], "Transport": ["uber"], "Refunds & Cashback": ["refund"],
    "Transfers": ["upi/dr"],
}

ORDER_CATEGORIES = {"1-URGENT": "Food & Dining", "2-HIGH": "Groceries", "3-MEDIUM": "Rent", "4-NOT SPECIFIED": "Transfers"}
MERCHANTS = ["Swiggy", "Swiggy Limited", "Blinkit", "Hpcl Petrol Pump", "Netflix", None]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_ms(ts: str) -> Column:
    """Wall-clock milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(
        f"CAST(datediff(CAST({ts} AS DATE), DATE'1970-01-01') AS BIGINT) * {DAY_MS} + (hour({ts}) * 60 + minute({ts})) * 60000L"
        f" + CAST(floor(extract(SECOND FROM {ts}) * 1000) AS BIGINT)"
    )


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long")


def one_of(key: Column, values: list) -> Column:
    return F.get(F.array(*map(F.lit, values)), key.cast("int"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    category = F.lit("Salary")
    for k, v in ORDER_CATEGORIES.items():
        category = F.when(F.col("o_orderpriority") == k, v).otherwise(category)
    return o.select(
        key.alias("id"), F.expr("o_custkey div 10").alias("user_id"), F.when(cust % 10 != 0, cust).alias("account_id"), cents("o_totalprice").alias("amount_paise"),
        F.when(F.col("o_orderstatus") == "O", "credit").otherwise("debit").alias("direction"), F.when(key % 4 == 3, F.concat(F.lit("Note "), key % 20)).alias("title"),
        one_of(key % 6, MERCHANTS).alias("merchant"), category.alias("category"), wall_ms("o_orderdate").alias("occurred_at_ms"),
        one_of(key % 4, ["sms", "notification", "manual", "manual"]).alias("source"), F.when(key % 7 == 0, "pending").otherwise("confirmed").alias("status"),
        one_of(key % 4, ["HDFCBK", "com.phonepe.app", "statement:table", None]).alias("raw_sender"),
        F.when(key % 3 == 0, F.concat(F.lit("Paid by UPI/DR/"), 500000000000 + key, F.lit("/SHOP"))).alias("raw_body"),
        F.when(key % 4 == 2, F.concat(F.lit("stmt|table|"), 700000 + key)).otherwise(F.concat(F.lit("k|"), key)).alias("dedup_key"),
        F.when(key % 5 == 0, (900000 + key).cast("string")).alias("reference"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("o_custkey div 10").alias("user_id"))
    return table(spark, sf_dir, "lineitem").join(owners, "l_orderkey").select(
        "user_id", F.col("l_orderkey").alias("transaction_id"), F.col("l_suppkey").alias("person_id"), (cents("l_extendedprice") % 50000 + 1).alias("amount_paise"),
        F.when(F.col("l_returnflag") == "R", "i_owe").otherwise("owed_to_me").alias("direction"), F.when(F.col("l_linestatus") == "F", wall_ms("l_shipdate")).alias("settled_at_ms"),
    )


SHOUTED = ["SWIGGY", "BLINKIT", "NETFLIX", "UBER INDIA", "AMAZON"]


#: Events of one task: their files are small and in few row groups, the messages made of them take seconds to read.
TASK_EVENTS = 50_000


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events, over tasks that hold so many of them, and over all cores: reading the messages made of them costs far more than the exchange."""
    rows = table(spark, sf_dir, "events")
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // TASK_EVENTS))
    rows = rows.select("event_id", "user_id", "event_type", "ts", "value").repartition(tasks, "event_id")
    return rows.select("event_id", "user_id", "event_type", wall_ms("ts").alias("ms"), cents("value").alias("p"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of five shapes; every third event has a second-source copy up to 899 minutes later, and error events are one-time passwords."""
    e = _event_rows(spark, sf_dir).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).filter("k = 0 or event_id % 3 = 0")
    amount = F.concat_ws(".", F.expr("p div 100"), F.lpad((F.col("p") % 100).cast("string"), 2, "0"))
    shop, last4 = one_of(F.col("event_id") % 5, SHOUTED), (1000 + (10 * F.col("user_id") + F.col("event_id") % 12) % 97).cast("string")
    kind = F.col("event_type")
    body = (
        F.when(F.col("k") == 1, F.concat(F.lit("₹"), amount, F.lit(" paid to "), shop, F.lit(" Limited")))
        .when(kind == "error", F.concat(F.lit("123456 is your OTP for a transaction of Rs."), amount, F.lit(" at "), shop, F.lit(". Do not share.")))
        .when(kind == "signup", F.concat(F.lit("Rs."), amount, F.lit(" credited to A/c XX"), last4, F.lit(" as refund from "), shop, F.lit(".")))
        .when(kind == "purchase", F.concat(F.lit("INR "), amount, F.lit(" debited from A/c XX"), last4, F.lit(". Info: UPI/"), 500000000000 + F.col("event_id"), F.lit("/"), shop))
        .otherwise(F.concat(F.lit("Rs."), amount, F.lit(" spent on HDFC Bank Card x"), last4, F.lit(" at "), shop, F.lit(" Ref "), 400000 + F.col("event_id")))
    )
    first = F.col("k") == 0
    return e.select(
        (F.col("event_id") * 2 + F.col("k")).alias("id"), "user_id", F.when(first, "sms").otherwise("notification").alias("source"),
        F.when(first, "HDFCBK").otherwise("com.phonepe.app").alias("sender"), body.alias("body"), (F.col("ms") + F.col("k") * (F.col("event_id") % 900) * 60000).alias("posted_at_ms"),
    )


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of a statement for each payment that an event stands for; a user has three files."""
    e = _event_rows(spark, sf_dir).filter("p > 0")
    key = F.col("event_id")
    reference = F.when(F.col("event_type") == "purchase", (500000000000 + key).cast("string")).when(key % 8 == 1, F.concat(F.lit("900000"), 400000 + key))
    return e.select(
        key.alias("id"), "user_id", F.concat("user_id", F.lit("-"), key % 3).alias("file_id"), F.col("p").alias("amount_paise"), F.lit("debit").alias("direction"),
        one_of(key % 5, ["Swiggy Limited", "Blinkit", "Netflix", "Uber India", "Amazon Pay"]).alias("merchant"),
        (F.floor(F.col("ms") / DAY_MS) * DAY_MS + NOON_MS).alias("occurred_at_ms"), F.lit(False).alias("has_exact_time"),
        one_of(key % 3, ["XX1234", "9876543210", None]).alias("account_mask"), reference.alias("reference"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = {"AUTOMOBILE": "credit_card", "BUILDING": "debit_card", "FURNITURE": "upi"}
    named = F.lit("bank")
    for k, v in kind.items():
        named = F.when(F.col("c_mktsegment") == k, v).otherwise(named)
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.expr("c_custkey div 10").alias("user_id"), F.col("c_name").alias("name"), F.lpad((1000 + key % 97).cast("string"), 4, "0").alias("last4"), named.alias("kind"),
        (key % 13 == 0).alias("archived"),
    )


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom a user has shared a payment with."""
    known = splits(spark, sf_dir).select("user_id", F.col("person_id").alias("id")).distinct()
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 10 == 0).alias("archived"))
    return known.join(named, "id").select("user_id", "id", "name", "archived")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The built-in categories, and for every fourth user a category of their own that only moves money."""
    own = accounts(spark, sf_dir).filter("user_id % 4 = 0").select("user_id").distinct()
    own = own.select(F.lit(900).cast("long").alias("id"), F.lit("Rent").alias("name"), F.lit("expense").alias("kind"), F.lit(True).alias("money_moved"), F.lit(False).alias("archived"), F.lit(900).alias("sort_order"), F.lit(False).alias("builtin"), "user_id")
    return seed_categories(spark).unionByName(own)


def category_rules(spark: SparkSession, sf_dir: str = "") -> DataFrame:
    return spark.createDataFrame(RULES, RULES_SCHEMA)


def keyword_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(category, keyword, place): the short list above, then for the built-in categories in turn the shop numbers that end a message, some hundreds."""
    first = [(c, w, 1_000 * i + j) for i, (c, ws) in enumerate(KEYWORDS.items()) for j, w in enumerate(ws)]
    names = F.array(*[F.lit(r[1]) for r in seed_rows()])
    k = transactions(spark, sf_dir).select((F.col("id") % 1000).alias("k")).filter("k < 700").distinct()
    more = k.select(F.element_at(names, (F.col("k") % 40 + 1).cast("int")).alias("category"), F.concat(F.lpad("k", 3, "0"), F.lit("/s")).alias("keyword"), (100_000 + 1_000 * (F.col("k") % 40) + F.col("k")).cast("int").alias("place"))
    return spark.createDataFrame(first, "category string, keyword string, place int").unionByName(more)


def _value(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in rows)


_EVENTS = "(SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, CAST(round(value * 100) AS BIGINT) AS p FROM events)"

#: The same tables for DuckDB, as common table expressions.
SQL = f"""
transactions AS (SELECT o_orderkey AS id, o_custkey // 10 AS user_id, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS account_id,
  CAST(round(o_totalprice * 100) AS BIGINT) AS amount_paise, CASE WHEN o_orderstatus = 'O' THEN 'credit' ELSE 'debit' END AS direction,
  CASE WHEN o_orderkey % 4 = 3 THEN 'Note ' || (o_orderkey % 20) END AS title,
  CASE o_orderkey % 6 WHEN 0 THEN 'Swiggy' WHEN 1 THEN 'Swiggy Limited' WHEN 2 THEN 'Blinkit' WHEN 3 THEN 'Hpcl Petrol Pump' WHEN 4 THEN 'Netflix' END AS merchant,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Food & Dining' WHEN '2-HIGH' THEN 'Groceries' WHEN '3-MEDIUM' THEN 'Rent' WHEN '4-NOT SPECIFIED' THEN 'Transfers'
    ELSE 'Salary' END AS category,
  epoch_us(o_orderdate) // 1000 AS occurred_at_ms, CASE o_orderkey % 4 WHEN 0 THEN 'sms' WHEN 1 THEN 'notification' ELSE 'manual' END AS source,
  CASE WHEN o_orderkey % 7 = 0 THEN 'pending' ELSE 'confirmed' END AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'HDFCBK' WHEN 1 THEN 'com.phonepe.app' WHEN 2 THEN 'statement:table' END AS raw_sender,
  CASE WHEN o_orderkey % 3 = 0 THEN 'Paid by UPI/DR/' || (500000000000 + o_orderkey) || '/SHOP' END AS raw_body,
  CASE WHEN o_orderkey % 4 = 2 THEN 'stmt|table|' || (700000 + o_orderkey) ELSE 'k|' || o_orderkey END AS dedup_key,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(900000 + o_orderkey AS VARCHAR) END AS reference FROM orders),
splits AS (SELECT o_custkey // 10 AS user_id, l_orderkey AS transaction_id, l_suppkey AS person_id, CAST(round(l_extendedprice * 100) AS BIGINT) % 50000 + 1 AS amount_paise,
  CASE WHEN l_returnflag = 'R' THEN 'i_owe' ELSE 'owed_to_me' END AS direction, CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate) // 1000 END AS settled_at_ms
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
captures AS (SELECT event_id * 2 + k AS id, user_id, CASE WHEN k = 0 THEN 'sms' ELSE 'notification' END AS source,
  CASE WHEN k = 0 THEN 'HDFCBK' ELSE 'com.phonepe.app' END AS sender,
  CASE WHEN k = 1 THEN '₹' || amt || ' paid to ' || mer || ' Limited'
    WHEN event_type = 'error' THEN '123456 is your OTP for a transaction of Rs.' || amt || ' at ' || mer || '. Do not share.'
    WHEN event_type = 'signup' THEN 'Rs.' || amt || ' credited to A/c XX' || l4 || ' as refund from ' || mer || '.'
    WHEN event_type = 'purchase' THEN 'INR ' || amt || ' debited from A/c XX' || l4 || '. Info: UPI/' || (500000000000 + event_id) || '/' || mer
    ELSE 'Rs.' || amt || ' spent on HDFC Bank Card x' || l4 || ' at ' || mer || ' Ref ' || (400000 + event_id) END AS body,
  ms + k * (event_id % 900) * 60000 AS posted_at_ms
  FROM (SELECT e.*, k, (p // 100) || '.' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') AS amt, CAST(1000 + (10 * user_id + event_id % 12) % 97 AS VARCHAR) AS l4,
          CASE event_id % 5 WHEN 0 THEN 'SWIGGY' WHEN 1 THEN 'BLINKIT' WHEN 2 THEN 'NETFLIX' WHEN 3 THEN 'UBER INDIA' ELSE 'AMAZON' END AS mer
        FROM {_EVENTS} e, (SELECT unnest([0, 1]) AS k)) WHERE k = 0 OR event_id % 3 = 0),
statement_rows AS (SELECT event_id AS id, user_id, user_id || '-' || event_id % 3 AS file_id, p AS amount_paise, 'debit' AS direction,
  CASE event_id % 5 WHEN 0 THEN 'Swiggy Limited' WHEN 1 THEN 'Blinkit' WHEN 2 THEN 'Netflix' WHEN 3 THEN 'Uber India' ELSE 'Amazon Pay' END AS merchant,
  (ms // 86400000) * 86400000 + 43200000 AS occurred_at_ms, FALSE AS has_exact_time,
  CASE event_id % 3 WHEN 0 THEN 'XX1234' WHEN 1 THEN '9876543210' END AS account_mask,
  CASE WHEN event_type = 'purchase' THEN CAST(500000000000 + event_id AS VARCHAR) WHEN event_id % 8 = 1 THEN '900000' || (400000 + event_id) END AS reference
  FROM {_EVENTS} WHERE p > 0),
accounts AS (SELECT c_custkey AS id, c_custkey // 10 AS user_id, c_name AS name, lpad(CAST(1000 + c_custkey % 97 AS VARCHAR), 4, '0') AS last4,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'credit_card' WHEN 'BUILDING' THEN 'debit_card' WHEN 'FURNITURE' THEN 'upi' ELSE 'bank' END AS kind,
  c_custkey % 13 = 0 AS archived FROM customer),
people AS (SELECT DISTINCT user_id, s_suppkey AS id, s_name AS name, s_suppkey % 10 = 0 AS archived FROM splits JOIN supplier ON s_suppkey = person_id),
categories(id, name, kind, money_moved, archived, sort_order, builtin) AS (VALUES {_values(seed_rows())}),
keyword_table(category, keyword, place) AS (SELECT * FROM (VALUES {_values([(c, w, 1_000 * i + j) for i, (c, ws) in enumerate(KEYWORDS.items()) for j, w in enumerate(ws)])}) UNION ALL
  SELECT c.name, lpad(CAST(k AS VARCHAR), 3, '0') || '/s', 100000 + 1000 * (k % 40) + k FROM (SELECT DISTINCT o_orderkey % 1000 AS k FROM orders) JOIN categories c ON c.id = k % 40 + 1 WHERE k < 700),
category_rules(id, user_id, pattern, category, field, match_type, direction, min_paise, max_paise, priority, enabled, origin, hits) AS (VALUES {_values(RULES)})"""


def sql(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ", ".join([SQL, *ctes]) + "\n" + body
