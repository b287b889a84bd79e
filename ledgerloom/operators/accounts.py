"""Accounts behind messages and statements: found by their digits, made where missing; transfers between one's own accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statements import mask_digits
from ..sources.shared import written


def guess_account_kind(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("credit card") | low.contains("cc "), "credit_card").when(low.contains("debit card"), "debit_card").when(low.contains("upi") | low.contains("vpa"), "upi").otherwise("bank")


def known_accounts(accounts: DataFrame) -> DataFrame:
    """(user_id, last4, account_id): the unarchived account of each number, the lowest id if several."""
    return accounts.filter(~F.col("archived") & F.col("last4").isNotNull()).groupBy("user_id", "last4").agg(F.min("id").alias("account_id"))


def resolve_account_last4(parsed: DataFrame, accounts: DataFrame) -> DataFrame:
    """The parsed rows with account_id, and account_name and account_kind for those whose account is yet to be made."""
    made = F.col("account_id").isNull() & F.col("last4").isNotNull()
    out = parsed.join(known_accounts(accounts), ["user_id", "last4"], "left")
    return out.withColumn("new_name", F.when(made, F.concat(F.lit("Card ••"), F.col("last4")))).withColumn("new_kind", F.when(made, guess_account_kind(F.col("body"))))


def new_accounts(resolved: DataFrame) -> DataFrame:
    """The accounts to make, a row per user and number, of the kind its first message suggests."""
    missing = resolved.filter("new_name is not null")
    return missing.groupBy("user_id", "last4").agg(F.min("new_name").alias("name"), F.min_by("new_kind", F.struct(-F.col("posted_at_ms"), "id")).alias("kind"))


def resolve_account_mask(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Statement rows with account_id by their mask: four digits are an account's last4, others name a UPI account; new_name and new_kind where none is held."""
    named = accounts.filter(~F.col("archived")).groupBy("user_id", F.col("name").alias("upi_name")).agg(F.min("id").alias("named_id"))
    digits = mask_digits(F.col("account_mask"))
    wanted = rows.withColumn("digits", digits).withColumn("last4", F.when(F.length("digits") == 4, F.col("digits")))
    wanted = wanted.withColumn("upi_name", F.when(F.length("digits") != 4, F.concat(F.lit("UPI ••"), F.col("digits"))))
    found = wanted.join(known_accounts(accounts), ["user_id", "last4"], "left").join(named, ["user_id", "upi_name"], "left")
    account = F.coalesce("account_id", "named_id")
    made = account.isNull() & F.col("digits").isNotNull()
    return found.withColumn("account_id", account).withColumn("new_name", F.when(made, F.coalesce("upi_name", F.concat(F.lit("Card ••"), F.col("last4"))))).withColumn(
        "new_kind", F.when(made, F.when(F.col("last4").isNotNull(), "debit_card").otherwise("upi"))
    )


def is_self_transfer(parsed: DataFrame, accounts: DataFrame) -> DataFrame:
    """(user_id, id) of messages that quote two numbers or more that were the user's own before the message came.

    Own are the held accounts, and those that an earlier message of the batch (the later in time) has made; the first sight of each number is one partial minimum.
    """
    parsed = written(parsed.select("user_id", "id", "posted_at_ms", "last4", "all_last4"), "quoted")  # read from the messages once, for what makes an account and for what is quoted
    held = accounts.filter(~F.col("archived") & F.col("last4").isNotNull()).select("user_id", "last4", F.lit(None).cast("struct<at: long, id: long>").alias("since"))
    order = F.struct((-F.col("posted_at_ms")).alias("at"), (-F.col("id")).alias("id"))
    made = parsed.filter("last4 is not null").select("user_id", "last4", order.alias("since"))
    # a null since is a held account, and stays the least
    own = held.unionByName(made).groupBy("user_id", "last4").agg(F.min("since").alias("since"), F.max(F.col("since").isNull()).alias("held"))
    quoted = parsed.select("user_id", "id", order.alias("now"), F.explode("all_last4").alias("last4"))
    known = quoted.join(own, ["user_id", "last4"]).filter(F.col("held") | (F.col("since") < F.col("now")))
    return known.groupBy("user_id", "id").agg(F.count("*").alias("n_own")).filter("n_own >= 2").select("user_id", "id")


def txn_with_account(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    return ledger.join(accounts.select("user_id", F.col("id").alias("account_id"), F.col("name").alias("account_name")), ["user_id", "account_id"], "left")
