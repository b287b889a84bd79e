"""Questions to the ledger: filters, pages, totals, breakdowns and changes.

Times are wall-clock milliseconds; ranges are half-open. `spent` is a debit's amount less what was lent out on it, `moved` are debits in money-moved categories.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.messages import capture_origin
from ..functions.periods import cycle_start
from ..functions.text import day_of, ms_of
from .accounts import txn_with_account

PAGE_ROWS = 50
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def in_range(at: Column, start_ms: int | None, end_ms: int | None) -> Column:
    test = F.lit(True)
    if start_ms is not None:
        test = test & (at >= start_ms)
    return test if end_ms is None else test & (at < end_ms)


def history_filter(
    ledger: DataFrame, search: str | None = None, origin: str | None = None, start_ms: int | None = None, end_ms: int | None = None, categories: list[str] | None = None
) -> DataFrame:
    """Confirmed rows by search text, origin, time and categories; what isn't given doesn't filter. `%` and `_` in a search are wild, a backslash is itself, and only A to Z are alike in both cases."""
    test = (F.col("status") == "confirmed") & in_range(F.col("occurred_at_ms"), start_ms, end_ms)
    if search and search.strip():
        like = f"%{search.strip()}%".translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
        hit = [F.coalesce(F.translate(F.col(c), UPPER, LOWER).like(like), F.lit(False)) for c in ("title", "merchant", "note", "category") if c in ledger.columns]
        found = hit[0]
        for h in hit[1:]:
            found = found | h
        test = test & found
    if origin and origin != "all":
        statement = F.coalesce(F.col("raw_sender").startswith("statement:"), F.lit(False))
        test = test & {"statement": statement, "manual": (F.col("source") == "manual") & ~statement}.get(origin, F.col("source") == origin)
    return ledger.filter(test & F.col("category").isin(categories) if categories else test)


def newest(ledger: DataFrame) -> W:
    return W.partitionBy("user_id").orderBy(F.desc("occurred_at_ms"), F.desc("id"))


def history_page(filtered: DataFrame, limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """Each user's page of the filtered rows, newest first; the bound on the row number lets Spark keep the top of each partition only."""
    at = F.row_number().over(newest(filtered))
    return filtered.withColumn("row_no", at).filter((F.col("row_no") <= limit + offset) & (F.col("row_no") > offset))


def history_by_month(filtered: DataFrame) -> DataFrame:
    month = ms_of(F.trunc(day_of(F.col("occurred_at_ms")), "month"))
    return filtered.groupBy("user_id", month.alias("month_ms")).agg(F.count("*").alias("n"), F.max("occurred_at_ms").alias("newest_ms"), F.sum("amount_paise").alias("total_paise"))


def pending(ledger: DataFrame) -> DataFrame:
    return ledger.filter("status = 'pending'")


def lent_per_txn(splits: DataFrame) -> DataFrame:
    """(user_id, id, lent_paise): what others owe of each payment, settled or not."""
    return splits.filter("direction = 'owed_to_me'").groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.sum("amount_paise").alias("lent_paise"))


def is_moved(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """The ledger with `moved`: whether its category only moves money, for its user or, where user_id is null, for all.

    Names for all users are settings, a literal set beside the ledger, which is not shuffled by its few, skewed categories; users' own are joined by user and name.
    """
    names = categories.filter("money_moved").select("user_id", "name").distinct()
    common = [r["name"] for r in names.filter("user_id is null").select("name").collect()]
    own = names.filter("user_id is not null").select("user_id", F.col("name").alias("category"), F.lit(True).alias("__own"))
    hit = F.coalesce(F.col("category").isin(common), F.lit(False)) if common else F.lit(False)
    return ledger.join(own, ["user_id", "category"], "left").withColumn("moved", hit | F.coalesce("__own", F.lit(False))).drop("__own")


def with_lent(ledger: DataFrame, splits: DataFrame, categories: DataFrame) -> DataFrame:
    """The ledger with lent_paise and moved; one shuffle, by (user, payment), which the sums of the splits share."""
    out = is_moved(ledger, categories).join(lent_per_txn(splits), ["user_id", "id"], "left")
    return out.withColumn("lent_paise", F.coalesce("lent_paise", F.lit(0)))


def totals() -> list[Column]:
    """The five figures, for a frame from `with_lent`."""
    debit, moved = F.col("direction") == "debit", F.col("moved")
    total = lambda test, value, name: F.coalesce(F.sum(F.when(test, value).otherwise(0)), F.lit(0)).alias(name)
    return [
        F.count("*").alias("n"), total(debit & ~moved, F.col("amount_paise") - F.col("lent_paise"), "spent"), total(~debit & ~moved, F.col("amount_paise"), "earned"),
        total(debit & moved, F.col("amount_paise"), "moved_paise"), total(debit, F.col("lent_paise"), "lent"),
    ]


def range_summary(full: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Totals and net per user of the confirmed rows in the range."""
    rows = full.filter((F.col("status") == "confirmed") & in_range(F.col("occurred_at_ms"), start_ms, end_ms))
    return rows.groupBy("user_id").agg(*totals()).withColumn("net", F.col("earned") - F.col("spent"))


def _spending(full: DataFrame, start_ms: int | None, end_ms: int | None) -> DataFrame:
    """What counts as spending, each row with its own part of it."""
    rows = full.filter((F.col("status") == "confirmed") & in_range(F.col("occurred_at_ms"), start_ms, end_ms) & (F.col("direction") == "debit") & ~F.col("moved"))
    return rows.withColumn("own_paise", F.col("amount_paise") - F.col("lent_paise"))


def by_category(full: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Spending per user and category, with its part of the user's largest."""
    out = _spending(full, start_ms, end_ms).groupBy("user_id", "category").agg(F.sum("own_paise").alias("total"))
    return out.withColumn("share", F.col("total") / F.max("total").over(W.partitionBy("user_id")))


def by_account(full: DataFrame, accounts: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    named = txn_with_account(_spending(full, start_ms, end_ms), accounts)
    return named.groupBy("user_id", "account_name").agg(F.sum("own_paise").alias("total"))


def summary_cube(full: DataFrame, accounts: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """The user's totals, categories and accounts in one scan: grouping sets over the confirmed rows. `level` is user, category or account."""
    rows = full.filter((F.col("status") == "confirmed") & in_range(F.col("occurred_at_ms"), start_ms, end_ms))
    named = txn_with_account(rows, accounts)
    sets = named.groupingSets([["user_id"], ["user_id", "category"], ["user_id", "account_name"]], "user_id", "category", "account_name")
    out = sets.agg(F.grouping_id().alias("g"), *totals())
    level = F.when(F.col("g") == 3, "user").when(F.col("g") == 1, "category").otherwise("account")
    return out.select("user_id", level.alias("level"), F.coalesce("category", "account_name").alias("name"), "n", "spent", "earned", "moved_paise", "lent")


def summary_by_period(full: DataFrame, cycle_day: int = 1) -> DataFrame:
    """The totals of every day, week, cycle and year that has rows, in one pass over them."""
    day = day_of(F.col("occurred_at_ms"))
    starts = {"day": day, "week": F.date_trunc("week", day).cast("date"), "cycle": cycle_start(day, cycle_day), "year": F.trunc(day, "year")}
    periods = F.array(*[F.struct(F.lit(k).alias("period"), ms_of(v).alias("start_ms")) for k, v in starts.items()])
    rows = full.filter("status = 'confirmed'").withColumn("p", F.explode(periods))
    return rows.groupBy("user_id", F.col("p.period").alias("period"), F.col("p.start_ms").alias("start_ms")).agg(*totals())


def running_totals(full: DataFrame) -> DataFrame:
    """(user_id, day_ms, n, spent, earned, month_spent, month_earned, ever_spent, ever_earned): each day that has rows, with the sums of its month and of all time up to it.

    Prefix sums in two levels: days within their month, and months before it; so a user's life is never one sort of days, and rows only meet in the daily sums.
    """
    day = day_of(F.col("occurred_at_ms"))
    days = full.filter("status = 'confirmed'").groupBy("user_id", ms_of(F.trunc(day, "month")).alias("month_ms"), ms_of(day).alias("day_ms")).agg(*totals()).select("user_id", "month_ms", "day_ms", "n", "spent", "earned")
    in_month = W.partitionBy("user_id", "month_ms").orderBy("day_ms").rowsBetween(W.unboundedPreceding, 0)
    inside = days.select("*", *[F.sum(c).over(in_month).alias(f"month_{c}") for c in ("spent", "earned")])
    months = days.groupBy("user_id", "month_ms").agg(F.sum("spent").alias("s"), F.sum("earned").alias("e"))
    earlier = W.partitionBy("user_id").orderBy("month_ms").rowsBetween(W.unboundedPreceding, -1)
    before = months.select("user_id", "month_ms", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("s", "e")])
    ever = [(F.col(f"before_{c[0]}") + F.col(f"month_{c}")).alias(f"ever_{c}") for c in ("spent", "earned")]
    return inside.join(before, ["user_id", "month_ms"]).select("user_id", "day_ms", "n", "spent", "earned", "month_spent", "month_earned", *ever)


def category_usage(ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """(user_id, category, transactions, rules); rules for all users stand under a null user_id."""
    count = lambda df, name: df.groupBy("user_id", "category").agg(F.count("*").alias(name))
    a, b = count(ledger, "transactions").alias("a"), count(rules, "rules").alias("b")
    both = a.join(b, F.col("a.user_id").eqNullSafe(F.col("b.user_id")) & F.col("a.category").eqNullSafe(F.col("b.category")), "full")
    there = F.col("transactions").isNotNull()
    own = lambda c: F.when(there, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select(own("user_id"), own("category"), F.coalesce("transactions", F.lit(0)).alias("transactions"), F.coalesce("rules", F.lit(0)).alias("rules"))


def deletable_categories(categories: DataFrame, ledger: DataFrame, rules: DataFrame) -> DataFrame:
    """The categories that nothing uses: a user's own by that user or a rule for all, one of all users by anybody."""
    used = ledger.select("user_id", "category").union(rules.select("user_id", "category")).distinct().withColumnRenamed("category", "name")
    anybody = used.select("name").distinct()
    own = categories.filter("user_id is not null").join(used, ["user_id", "name"], "left_anti").join(used.filter("user_id is null").select("name"), "name", "left_anti")
    return categories.filter("user_id is null").join(anybody, "name", "left_anti").select(*categories.columns).unionByName(own.select(*categories.columns))


def upsert(ledger: DataFrame, inserts: DataFrame, updates: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """The next version of the ledger: deletes go, updates (user_id, id and new columns) replace, inserts are ignored where their key is held.

    Of several inserts with one key the lowest id is taken. Deletes come first, so a row that replaces another may use its key.
    """
    held = ledger if deletes is None else ledger.join(deletes.select("user_id", "id"), ["user_id", "id"], "left_anti")
    if updates is not None:
        changed = [c for c in updates.columns if c not in ("user_id", "id")]
        new = updates.select("user_id", "id", F.lit(True).alias("__hit"), *[F.col(c).alias(f"__{c}") for c in changed])
        joined = held.join(new, ["user_id", "id"], "left")
        held = joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in ledger.columns])
    fresh = inserts.join(held.select("user_id", "dedup_key"), ["user_id", "dedup_key"], "left_anti")
    first = F.row_number().over(W.partitionBy("user_id", "dedup_key").orderBy("id"))
    return held.unionByName(fresh.withColumn("__n", first).filter("__n = 1").drop("__n"), allowMissingColumns=True)


def write_ledger(ledger: DataFrame, path: str, version: int) -> None:
    """The ledger as a version of its own, by user bucket and month; writing a version again replaces it, and no other version is touched."""
    placed = ledger.withColumn("user_bucket", F.pmod(F.xxhash64("user_id"), F.lit(64)).cast("int")).withColumn("month", F.date_format(day_of(F.col("occurred_at_ms")), "yyyy-MM"))
    placed.repartition("user_bucket", "month").write.mode("overwrite").partitionBy("user_bucket", "month").parquet(f"{path}/version={version}")


def read_ledger(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").drop("user_bucket", "month")


def new_id(*key: str) -> Column:
    """An id for a row that has none, from its key: the same whenever it is made."""
    return F.shiftrightunsigned(F.xxhash64(*key), 1)


def origin(ledger: DataFrame) -> Column:
    return capture_origin(F.col("source"), F.col("raw_sender"))
