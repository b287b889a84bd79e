"""The category table: seed, names, renames, choices. A category with a null user_id is every user's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The built-in names, in order, and those that only move money.
EXPENSE = [
    "Food & Dining", "Groceries", "Transport", "Fuel", "Travel", "Shopping", "Clothing", "Electronics", "Bills & Utilities", "Mobile & Internet", "Rent", "Household",
    "Domestic Help", "Health", "Fitness", "Personal Care", "Education", "Kids & Family", "Pets", "Entertainment", "Subscriptions", "Insurance", "Loan & EMI",
    "Credit Card Payment", "Taxes & Fees", "Bank Charges", "Gifts & Donations", "Cash Withdrawal", "Investments", "Transfers", "Other",
]
INCOME = ["Salary", "Freelance", "Business", "Interest & Dividends", "Refunds & Cashback", "Rent Received", "Gifts Received", "Investments", "Transfers", "Other Income"]
#: Names of incoming money alone.
INCOME_ONLY = [n for n in INCOME if n not in EXPENSE]
LENDING = "Lending & Repayments"
MOVED = ["Transfers", "Credit Card Payment", "Cash Withdrawal", LENDING]
SCHEMA = "id long, name string, kind string, money_moved boolean, archived boolean, sort_order int, builtin boolean"


def seed_rows() -> list[tuple]:
    names = list(dict.fromkeys([*EXPENSE, *INCOME, LENDING]))
    kind = lambda n: "both" if n == LENDING or n in EXPENSE and n in INCOME else "income" if n in INCOME else "expense"
    return [(i + 1, n, kind(n), n in MOVED, False, i, True) for i, n in enumerate(names)]


def seed_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(seed_rows(), SCHEMA).withColumn("user_id", F.lit(None).cast("long"))


def normalize_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def judged_renames(renames: DataFrame, categories: DataFrame) -> DataFrame:
    """(user_id, old_name, new_name, reason): new names tidied; `reason` is null for the renames that hold.

    Refused are all renames of one name if it has several ("repeated"), an empty new name ("blank"), and one that is another category's already ("clash"), whatever its case.
    """
    tidy = renames.select("user_id", "old_name", normalize_name(F.col("new_name")).alias("new_name")).withColumn("n", F.count("*").over(W.partitionBy("user_id", "old_name")))
    held = categories.select("user_id", F.lower("name").alias("low"), "name").distinct()
    low = tidy.withColumn("low", F.lower("new_name"))
    own = low.join(held.filter("user_id is not null"), ["user_id", "low"]).filter("name != old_name").select("user_id", "old_name")
    common = low.join(held.filter("user_id is null").drop("user_id"), "low").filter("name != old_name").select("user_id", "old_name")
    clash = own.union(common).distinct().withColumn("clash", F.lit(True))
    reason = F.when(F.col("n") > 1, "repeated").when(F.col("new_name") == "", "blank").when(F.col("clash"), "clash")
    return tidy.join(clash, ["user_id", "old_name"], "left").select("user_id", "old_name", "new_name", reason.alias("reason"))


def rename_categories(frame: DataFrame, renames: DataFrame, categories: DataFrame, column: str = "category") -> DataFrame:
    """`frame` (the ledger, the rules or the categories, by `column`) with each user's names changed by (user_id, old_name, new_name); refused renames change nothing."""
    good = judged_renames(renames, categories).filter("reason is null").select("user_id", F.col("old_name").alias(column), F.col("new_name").alias("__new"))
    return frame.join(good, ["user_id", column], "left").withColumn(column, F.coalesce("__new", column)).select(*frame.columns)


def rename_counts(ledger: DataFrame, rules: DataFrame, renames: DataFrame) -> DataFrame:
    """(user_id, old_name, transactions, rules): what each rename would touch."""
    key = ["user_id", "old_name"]
    count = lambda df, name: df.groupBy("user_id", F.col("category").alias("old_name")).agg(F.count("*").alias(name))
    out = renames.select(*key).distinct().join(count(ledger, "transactions"), key, "left").join(count(rules, "rules"), key, "left")
    return out.select(*key, F.coalesce("transactions", F.lit(0)).alias("transactions"), F.coalesce("rules", F.lit(0)).alias("rules"))


def categories_for_direction(categories: DataFrame, direction: str) -> DataFrame:
    """(name) of the unarchived categories for a direction, `Other` if there are none. The fallback is a row that only an empty list lets through."""
    kind = "income" if direction == "credit" else "expense"
    fits = categories.filter(~F.col("archived") & F.col("kind").isin(kind, "both")).select("name", "sort_order")
    n = fits.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("Other").alias("name"), F.lit(0).alias("sort_order"))
    return fits.unionByName(n).select("name")


def orphan_categories(ledger: DataFrame, categories: DataFrame) -> DataFrame:
    """(user_id, name, kind) for each user's names that the table lacks."""
    used = ledger.select("user_id", F.col("category").alias("name")).distinct()
    own, common = (categories.filter(f"user_id is {x} null").select("user_id", "name") for x in ("not", ""))
    return used.join(common.select("name"), "name", "left_anti").join(own, ["user_id", "name"], "left_anti").select("user_id", "name", F.lit("both").alias("kind"))
