"""Raw messages: reading, assembling, filtering, exact dedup and the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import DAY_MS

SCHEMA = "id long, user_id long, source string, sender string, body string, posted_at_ms long"
MINUTE_MS = 60_000
DRAIN_ROWS, BACKFILL_ROWS = 200, 2_000

# What a message must and must not hold, and the payment apps whose notifications count.
AMOUNT = r"(?i)(?:rs\.?|inr|₹)\s*([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
MOVEMENT = r"(?i)\b(debited|credited|spent|paid|withdrawn|received|purchase|txn|transaction|transfer|sent to|deducted)\b"
NOISE = (
    r"(?i)\b(otp|one[- ]time password|verification code|do not share|will expire|e-?mandate reminder|due on|statement is ready|offer|cashback offer|apply now|loan offer"
    r"|pre-?approved)\b"
)
PAYMENT_APPS = [
    "com.google.android.apps.nbu.paisa.user", "com.phonepe.app", "com.phonepe.app.preprod", "net.one97.paytm", "in.org.npci.upiapp", "com.dreamplug.androidapp",
    "in.amazon.mShop.android.shopping", "com.mobikwik_new", "com.freecharge.android", "com.samsung.android.spay",
]


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet", stream: bool = False) -> DataFrame:
    """Messages from parquet, json or csv files, as a table or a stream of one schema."""
    reader = spark.readStream if stream else spark.read
    reader = reader.schema(SCHEMA).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


def assemble_multipart(parts: DataFrame) -> DataFrame:
    """(msg_id, sender, body, posted_at_ms) from (msg_id, seq, sender, body, posted_at_ms): a sender's parts in order; the last part's time is the message's."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("seq", "body"))), lambda p: F.coalesce(p["body"], F.lit("")))
    return parts.groupBy("msg_id", "sender").agg(F.trim(F.array_join(pieces, "")).alias("body"), F.max_by("posted_at_ms", "seq").alias("posted_at_ms"))


def notification_body(title: Column, big_text: Column, text: Column) -> Column:
    """Title and text, the long text if there is one, each once."""
    bare = lambda c: F.trim(F.coalesce(c, F.lit("")))
    said = F.when(bare(big_text) != "", bare(big_text)).otherwise(bare(text))
    return F.array_join(F.array_distinct(F.filter(F.array(bare(title), said), lambda x: x != "")), " — ")


def prefilter(captures: DataFrame) -> DataFrame:
    """Messages with an amount and a movement word and no noise; notifications of the payment apps only."""
    likely = F.col("body").rlike(AMOUNT) & F.col("body").rlike(MOVEMENT) & ~F.col("body").rlike(NOISE)
    return captures.filter(((F.col("source") != "notification") | F.col("sender").isin(PAYMENT_APPS)) & likely)


def exact_dedup(captures: DataFrame) -> DataFrame:
    """The first message, by id, of each (user, source, sender, body, minute). The body travels once, its hash keeps the key narrow and the body itself decides."""
    key = W.partitionBy("user_id", "source", "sender", F.floor(F.col("posted_at_ms") / MINUTE_MS), F.xxhash64("body"), "body").orderBy("id")
    return captures.withColumn("__n", F.row_number().over(key)).filter("__n = 1").drop("__n")


def drain_pending(captures: DataFrame, consumed: DataFrame, most: int = DRAIN_ROWS) -> DataFrame:
    """Each user's newest unconsumed messages. What is consumed is a list of (user_id, id), or their bitmaps."""
    if "bits" not in consumed.columns:
        return _newest(captures.join(consumed.select("user_id", "id"), ["user_id", "id"], "left_anti"), most)
    held = consumed.select("user_id", F.col("id_range").alias("__range"), F.col("bits").alias("__bits"))
    met = captures.withColumn("__range", F.bitmap_bucket_number("id")).join(held, ["user_id", "__range"], "left")
    return _newest(met.filter(~F.coalesce(_is_set(F.col("__bits"), F.bitmap_bit_position("id")), F.lit(False))).select(*captures.columns), most)


def _word(at: Column) -> Column:
    return F.shiftright(at, 6).cast("int")


def _is_set(bits: Column, at: Column) -> Column:
    return F.getbit(F.try_element_at(bits, _word(at)), (at % 64).cast("int")) == 1


def consumed_bitmaps(ids: DataFrame) -> DataFrame:
    """(user_id, id_range, bits): the ids (user_id, id) as one bitmap for each range of 32,768 ids, a map of its words of 64 bits that are not zero: a user with few ids in a range has a few bytes there."""
    return _joined_words(_id_words(ids))


def _id_words(ids: DataFrame) -> DataFrame:
    at = F.bitmap_bit_position("id")
    return ids.select("user_id", F.bitmap_bucket_number("id").alias("id_range"), _word(at).alias("word"), F.expr("shiftleft(1L, CAST(bitmap_bit_position(id) % 64 AS INT))").alias("held"))


def _joined_words(words: DataFrame) -> DataFrame:
    each = words.groupBy("user_id", "id_range", "word").agg(F.bit_or("held").alias("held"))
    return each.groupBy("user_id", "id_range").agg(F.map_from_entries(F.collect_list(F.struct("word", "held"))).alias("bits"))


def consumed_ids(bitmaps: DataFrame) -> DataFrame:
    """(user_id, id) of bitmaps of ids from 1 on."""
    every = F.filter(F.sequence(F.lit(0), F.lit(32_767)), lambda p: _is_set(F.col("bits"), p))
    return bitmaps.select("user_id", "id_range", F.explode(every).alias("p")).select("user_id", ((F.col("id_range") - 1) * 32_768 + F.col("p") + 1).alias("id"))


def _newest(captures: DataFrame, most: int) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.desc("posted_at_ms"), F.desc("id"))
    return captures.withColumn("row_no", F.row_number().over(order)).filter(F.col("row_no") <= most)


def mark_consumed(consumed: DataFrame, drained: DataFrame) -> DataFrame:
    """The consumed ids with those drained, as a list or, where they are kept so, as bitmaps. Marking twice changes nothing."""
    if "bits" in consumed.columns:
        return _joined_words(consumed.select("user_id", "id_range", F.explode("bits").alias("word", "held")).union(_id_words(drained)))
    return consumed.select("user_id", "id").union(drained.select("user_id", "id")).distinct()


def backfill_window(captures: DataFrame, now_ms: int, days: int, most: int = BACKFILL_ROWS) -> DataFrame:
    return _newest(captures.filter(F.col("posted_at_ms") >= now_ms - days * DAY_MS), most)
