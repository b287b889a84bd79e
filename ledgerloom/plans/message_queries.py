"""Queries over messages: sources, parsing, origins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages as m
from ..functions.text import day_of, squeezed
from ..sources import captures as c
from . import views as v
from .registry import query
from .views import sql



def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.captures(spark, sf_dir).withColumn("text", squeezed(F.col("body")))


# --- sources and the queue


@query("src_captures", sql("SELECT * FROM captures"))
def src_captures(spark, sf_dir):
    return v.captures(spark, sf_dir)


@query("assemble_multipart", sql("SELECT id AS msg_id, sender, trim(body) AS body, posted_at_ms + 2 AS posted_at_ms FROM captures"))
def assemble_multipart(spark, sf_dir):
    cut = lambda a, n: F.substr(F.col("body"), F.lit(a), F.lit(n))
    parts = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), cut(a, n).alias("body")) for i, a, n in ((2, 31, 10_000), (0, 1, 11), (1, 12, 19))])).alias("part")
    rows = v.captures(spark, sf_dir).select(F.col("id").alias("msg_id"), "sender", "posted_at_ms", parts)
    return c.assemble_multipart(rows.select("msg_id", "sender", "part.seq", "part.body", (F.col("posted_at_ms") + F.col("part.seq")).alias("posted_at_ms")))


@query(
    "assemble_notification",
    sql("""SELECT id, CASE id % 4 WHEN 0 THEN 'Paid — ' || body WHEN 1 THEN body WHEN 2 THEN body ELSE 'Paid — Paid to shop ' || id END AS body FROM captures"""),
)
def assemble_notification(spark, sf_dir):
    kind, body = F.col("id") % 4, F.col("body")
    title = F.when(kind == 1, F.lit(None)).when(kind == 2, body).otherwise("Paid ")
    big = F.when(kind == 3, F.concat(F.lit("Paid to shop "), F.col("id"))).when(kind == 0, "  ").otherwise(body)
    return v.captures(spark, sf_dir).select("id", c.notification_body(title, big, body).alias("body"))


PREFILTERED = """SELECT * FROM captures WHERE (source <> 'notification' OR sender = 'com.phonepe.app') AND regexp_matches(body, '(?i)(rs\\.?|inr|₹)\\s*[0-9]')
  AND regexp_matches(body, '(?i)\\b(debited|credited|spent|paid|withdrawn|received|purchase|txn|transaction|transfer|sent to|deducted)\\b')
  AND NOT regexp_matches(body, '(?i)\\b(otp|do not share|will expire|due on|offer|apply now)\\b')"""


@query("prefilter_captures", sql(PREFILTERED))
def prefilter_captures(spark, sf_dir):
    return c.prefilter(v.captures(spark, sf_dir))


@query(
    "capture_exact_dedup",
    sql(
        """SELECT min(id) AS id, user_id, source, sender, body, min_by(posted_at_ms, id) AS posted_at_ms
FROM (SELECT * FROM captures UNION ALL SELECT id + 1000000000, user_id, source, sender, body, posted_at_ms + (id % 90) * 1000 FROM captures WHERE id % 3 = 0)
GROUP BY user_id, source, sender, body, posted_at_ms // 60000"""
    ),
)
def capture_exact_dedup(spark, sf_dir):
    rows = v.captures(spark, sf_dir)
    again = rows.filter("id % 3 = 0").withColumn("posted_at_ms", F.col("posted_at_ms") + F.col("id") % 90 * 1000).withColumn("id", F.col("id") + 1000000000)
    return c.exact_dedup(rows.unionByName(again))


@query(
    "drain_pending",
    sql(
        """SELECT id, user_id, source, sender, body, posted_at_ms, row_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY posted_at_ms DESC, id DESC) AS INTEGER) AS row_no
FROM captures WHERE id % 5 <> 0) WHERE row_no <= 200"""
    ),
)
def drain_pending(spark, sf_dir):
    rows = v.captures(spark, sf_dir)
    return c.drain_pending(rows, rows.filter("id % 5 = 0"))


@query(
    "mark_consumed",
    sql(
        """SELECT user_id, id FROM captures WHERE id % 5 = 0 UNION
SELECT user_id, id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY posted_at_ms DESC, id DESC) AS n FROM captures WHERE id % 5 <> 0) WHERE n <= 200"""
    ),
)
def mark_consumed(spark, sf_dir):
    rows = v.captures(spark, sf_dir)
    done = rows.filter("id % 5 = 0")
    return c.mark_consumed(done, c.drain_pending(rows, done))


@query(
    "drain_with_bitmaps",
    sql(
        """SELECT user_id, max(n) AS drained, CAST(sum(CASE WHEN n <= 200 THEN id ELSE 0 END) AS BIGINT) AS ids, count(*) FILTER (WHERE n > 200) AS waiting
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY posted_at_ms DESC, id DESC) AS n FROM captures WHERE id % 5 <> 0) GROUP BY 1""".replace("max(n) AS drained", "least(max(n), 200) AS drained")
    ),
)
def drain_with_bitmaps(spark, sf_dir):
    """One drain over bitmaps of what was consumed, marked, and what a second drain would still find."""
    rows = v.captures(spark, sf_dir)
    done = c.consumed_bitmaps(rows.filter("id % 5 = 0"))
    first = c.drain_pending(rows, done)
    left = c.drain_pending(rows, c.mark_consumed(done, first), 1 << 30).groupBy("user_id").agg(F.count("*").alias("waiting"))
    got = first.groupBy("user_id").agg(F.count("*").alias("drained"), F.sum("id").alias("ids"))
    return got.join(left, "user_id", "left").select("user_id", "drained", "ids", F.coalesce("waiting", F.lit(0)).alias("waiting"))


NOW_MS = 1_706_600_000_000


@query(
    "backfill_window",
    sql(
        f"""SELECT id, user_id, source, sender, body, posted_at_ms, row_no FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY posted_at_ms DESC, id DESC) AS INTEGER) AS row_no
FROM captures WHERE posted_at_ms >= {NOW_MS} - 15 * 86400000::BIGINT) WHERE row_no <= 2000"""
    ),
)
def backfill_window(spark, sf_dir):
    return c.backfill_window(v.captures(spark, sf_dir), NOW_MS, 15)


# --- parsing; the SQL says what each of the five message shapes holds, apart from the patterns


@query("is_noise", sql("SELECT id, body LIKE '%OTP%' AS noise FROM captures"))
def is_noise(spark, sf_dir):
    return texts(spark, sf_dir).select("id", m.is_noise(F.col("text")).alias("noise"))


@query("has_movement", sql("SELECT id, body LIKE '%paid%' OR body LIKE '%spent%' OR body LIKE '%credited%' OR body LIKE '%debited%' OR body LIKE '%transaction%' AS moved FROM captures"))
def has_movement(spark, sf_dir):
    return texts(spark, sf_dir).select("id", m.has_movement(F.col("text")).alias("moved"))


AMOUNT = "CAST(round(CAST(regexp_extract(body, '(?:Rs\\.|INR |₹)([0-9]+\\.[0-9]{2})', 1) AS DECIMAL(18,2)) * 100) AS BIGINT)"
AT = "CASE WHEN body LIKE '123456%' THEN position('Rs.' IN body) - 1 ELSE 0 END"


@query("extract_amount", sql(f"SELECT id, CASE WHEN {AMOUNT} > 0 THEN {AMOUNT} END AS amount_paise, CASE WHEN {AMOUNT} > 0 THEN CAST({AT} AS INTEGER) END AS at, CAST((id % 900 + 1) * 100 + 50 AS BIGINT) AS behind_paise, 9 AS behind_at FROM captures"))
def extract_amount(spark, sf_dir):
    """Of the messages, and of texts whose currency stands behind the number."""
    behind = F.concat(F.lit("You paid "), F.col("id") % 900 + 1, F.lit(".50 INR to a shop"))
    rows = texts(spark, sf_dir).withColumn("a", m.extract_amount(F.col("text"))).withColumn("b", m.extract_amount(behind))
    return rows.select("id", F.col("a.paise").alias("amount_paise"), "a.at", F.col("b.paise").alias("behind_paise"), F.col("b.at").alias("behind_at"))


DIRECTION = "CASE WHEN body LIKE '%credited%' THEN 'credit' WHEN body LIKE '%OTP%' THEN NULL ELSE 'debit' END"


@query("extract_direction", sql(f"SELECT id, CASE WHEN {AMOUNT} > 0 THEN {DIRECTION} END AS direction FROM captures"))
def extract_direction(spark, sf_dir):
    return texts(spark, sf_dir).withColumn("a", m.extract_amount(F.col("text"))).select("id", m.extract_direction(F.col("text"), F.col("a.at")).alias("direction"))


LAST4 = "nullif(regexp_extract(body, '(?:XX|Card x)([0-9]{4})', 1), '')"


@query("extract_last4", sql(f"SELECT id, {LAST4} AS last4 FROM captures"))
def extract_last4(spark, sf_dir):
    return texts(spark, sf_dir).select("id", m.extract_last4(F.col("text")).alias("last4"))


@query(
    "extract_all_last4",
    sql(f"""SELECT id, CASE WHEN {LAST4} IS NULL THEN CAST(7001 + id % 7 AS VARCHAR) ELSE {LAST4} || CASE WHEN {LAST4} = CAST(7001 + id % 7 AS VARCHAR) THEN '' ELSE ',' || (7001 + id % 7) END END AS numbers
FROM captures"""),
)
def extract_all_last4(spark, sf_dir):
    both = F.concat(F.col("text"), F.lit(" and credited to A/c XX"), 7001 + F.col("id") % 7, F.lit(" again XX"), 7001 + F.col("id") % 7)
    return texts(spark, sf_dir).select("id", F.array_join(m.extract_all_last4(both), ",").alias("numbers"))


SHOP = "CASE (id // 2) % 5 WHEN 0 THEN 'Swiggy' WHEN 1 THEN 'Blinkit' WHEN 2 THEN 'Netflix' WHEN 3 THEN 'Uber India' ELSE 'Amazon' END"
MERCHANT = f"CASE WHEN id % 2 = 1 THEN (CASE (id // 2) % 5 WHEN 0 THEN 'SWIGGY' WHEN 1 THEN 'BLINKIT' WHEN 2 THEN 'NETFLIX' WHEN 3 THEN 'UBER INDIA' ELSE 'AMAZON' END) || ' Limited' ELSE {SHOP} END"


@query("extract_merchant", sql(f"SELECT id, CASE WHEN body LIKE '%credited%' THEN {SHOP} ELSE {MERCHANT} END AS merchant, 'shop' || id % 7 AS handle FROM captures"))
def extract_merchant(spark, sf_dir):
    """Of the messages, and of texts that only name a payment handle."""
    handle = F.concat(F.lit("Rs.5 debited, VPA shop"), F.col("id") % 7, F.lit("@okaxis"))
    return texts(spark, sf_dir).select("id", m.extract_merchant(F.col("text")).alias("merchant"), m.extract_merchant(handle).alias("handle"))


@query(
    "extract_occurred_at",
    sql(
        """SELECT id, CASE WHEN d = posted_at_ms // 86400000 OR abs(d * 86400000 + 43200000 - posted_at_ms) > 45 * 86400000::BIGINT THEN posted_at_ms ELSE d * 86400000 + 43200000 END AS occurred_at_ms
FROM (SELECT id, posted_at_ms, posted_at_ms // 86400000 - CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 40 ELSE 60 END AS d FROM captures)"""
    ),
)
def extract_occurred_at(spark, sf_dir):
    back = v.one_of(F.col("id") % 4, [0, 1, 40, 60])
    day = F.date_sub(day_of(F.col("posted_at_ms")), back)
    dated = F.concat(F.lit("Rs.5 spent on "), F.when(F.col("id") % 3 == 0, F.date_format(day, "dd-MMM-yy")).when(F.col("id") % 3 == 1, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "dd MMM yyyy")))
    return v.captures(spark, sf_dir).select("id", m.extract_occurred_at(dated, F.col("posted_at_ms")).alias("occurred_at_ms"))


REFERENCE = "nullif(coalesce(nullif(regexp_extract(body, 'UPI/([0-9]+)', 1), ''), regexp_extract(body, 'Ref ([0-9]+)', 1)), '')"


@query("extract_reference", sql(f"SELECT id, {REFERENCE} AS reference, CASE id % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'U' WHEN 2 THEN 'T' ELSE 'F' END || (400000 + id) AS labelled FROM captures"))
def extract_reference(spark, sf_dir):
    """Of the messages, and of texts with the other labels."""
    label = v.one_of(F.col("id") % 4, ["RRN: R", "UTR No. U", "Transaction ID: T", "Reference number F"])
    labelled = F.concat(F.lit("Done. "), label, 400000 + F.col("id"))
    return texts(spark, sf_dir).select("id", m.extract_reference(F.col("text")).alias("reference"), m.extract_reference(labelled).alias("labelled"))


@query("parse_confidence", sql(f"SELECT id, CASE WHEN {LAST4} IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence FROM captures"))
def parse_confidence(spark, sf_dir):
    return texts(spark, sf_dir).select("id", m.parse_confidence(m.extract_merchant(F.col("text")), m.extract_last4(F.col("text"))).alias("confidence"))


KEY = """source || '|' || sender || '|' || posted_at_ms || '|' || lower(to_base(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(body, ''), lambda x: unicode(x)::BIGINT)),
  lambda h, x: (h * 33 + x) % 4294967296), 36))"""


@query("capture_key", sql(f"SELECT id, {KEY} AS dedup_key FROM captures"))
def capture_key(spark, sf_dir):
    return v.captures(spark, sf_dir).select("id", m.capture_key(F.col("source"), F.col("sender"), F.col("posted_at_ms"), F.col("body")).alias("dedup_key"))


@query("merchant_identity", sql("SELECT id, CASE WHEN length(n) >= 3 THEN n END AS identity FROM (SELECT id, regexp_replace(lower(coalesce(merchant, title)), '[^a-z0-9]', '', 'g') AS n FROM transactions)"))
def merchant_identity(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", m.merchant_identity(F.coalesce("merchant", "title")).alias("identity"))


ORIGIN = "CASE WHEN raw_sender LIKE 'statement:%' THEN 'statement' WHEN source IN ('sms', 'notification') THEN source ELSE 'manual' END"


@query("capture_origin", sql(f"SELECT id, {ORIGIN} AS origin FROM transactions"))
def capture_origin(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", m.capture_origin(F.col("source"), F.col("raw_sender")).alias("origin"))


@query("origin_badge", sql(f"SELECT id, CASE {ORIGIN} WHEN 'sms' THEN 'SMS' WHEN 'notification' THEN 'NOTIF' WHEN 'statement' THEN 'PDF' ELSE 'MANUAL' END AS badge FROM transactions"))
def origin_badge(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", m.origin_badge(m.capture_origin(F.col("source"), F.col("raw_sender"))).alias("badge"))


@query(
    "origin_description",
    sql(f"""SELECT id, CASE {ORIGIN} WHEN 'sms' THEN 'Read from a bank SMS' WHEN 'notification' THEN 'Read from a payment app notification'
  WHEN 'statement' THEN 'Imported from a statement PDF' ELSE 'Entered by hand' END AS description FROM transactions"""),
)
def origin_description(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", m.origin_description(m.capture_origin(F.col("source"), F.col("raw_sender"))).alias("description"))


@query(
    "payment_reference",
    sql("""SELECT id, CASE WHEN length(reference) >= 6 THEN reference WHEN dedup_key LIKE 'stmt|%' AND regexp_matches(split_part(dedup_key, '|', 3), '^[A-Za-z0-9]{6,}$')
  THEN split_part(dedup_key, '|', 3) END AS reference FROM transactions"""),
)
def payment_reference(spark, sf_dir):
    return v.transactions(spark, sf_dir).select("id", m.payment_reference(F.col("reference"), F.col("dedup_key")).alias("reference"))


@query("display_title", sql("SELECT id, coalesce(title, merchant, 'Unknown') AS shown FROM transactions"))
def display_title(spark, sf_dir):
    blank = F.when(F.col("title").isNull(), "  ").otherwise(F.concat(F.col("title"), F.lit(" ")))
    return v.transactions(spark, sf_dir).select("id", m.display_title(blank, F.col("merchant")).alias("shown"))


@query("backfill_reference", sql("SELECT id, coalesce(reference, regexp_extract(raw_body, 'UPI/DR/([0-9]+)', 1)) AS reference FROM transactions"))
def backfill_reference(spark, sf_dir):
    return m.backfill_reference(v.transactions(spark, sf_dir)).select("id", "reference")


PARSED = f"""parsed AS (SELECT id, user_id, source, sender, body, posted_at_ms, {AMOUNT} AS amount_paise, {DIRECTION} AS direction, {LAST4} AS last4,
  CASE WHEN body LIKE '%credited%' THEN {SHOP} ELSE {MERCHANT} END AS merchant, posted_at_ms AS occurred_at_ms, CASE WHEN {LAST4} IS NULL THEN 0.8 ELSE 1.0 END::DOUBLE AS confidence, {KEY} AS dedup_key, {REFERENCE} AS reference
  FROM captures WHERE body NOT LIKE '%OTP%' AND {AMOUNT} > 0)"""


@query("parse_capture", sql("SELECT id, user_id, amount_paise, direction, last4, merchant, occurred_at_ms, confidence, dedup_key, reference, coalesce(last4, '') AS numbers FROM parsed", PARSED))
def parse_capture(spark, sf_dir):
    rows = m.parse_captures(v.captures(spark, sf_dir))
    return rows.select("id", "user_id", "amount_paise", "direction", "last4", "merchant", "occurred_at_ms", "confidence", "dedup_key", "reference", F.array_join("all_last4", ",").alias("numbers"))
