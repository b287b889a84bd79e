"""Shared payments: exact shares, balances, settlement. A share is settled at a time, `settled_at_ms`, or open, where that is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_shares(amount: Column, parts: Column) -> Column:
    """An exact division into whole paise, the larger shares first; empty for nothing to divide or nobody."""
    share = F.transform(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1), lambda i: F.floor(amount / parts).cast("long") + F.when(i < amount % parts, 1).otherwise(0))
    return F.when((parts > 0) & (amount > 0), share).otherwise(F.array().cast("array<bigint>"))


def split_evenly_with_me(amount: Column, people: Column) -> Column:
    """array<struct(person_id, share_paise)>: what each friend owes; the payer keeps the first share, so spare paise are the payer's."""
    n = F.size(people)
    theirs = F.slice(even_shares(amount, n + 1), F.lit(2), F.greatest(n, F.lit(0)))
    return F.when((n > 0) & (amount > 0), F.transform(people, lambda p, i: F.struct(p.alias("person_id"), F.get(theirs, i).alias("share_paise")))).otherwise(
        F.array().cast("array<struct<person_id:bigint,share_paise:bigint>>")
    )


def toggle_share(people: Column, person: Column, amount: Column) -> Column:
    """The shares after a person is added, or taken off if among them; everyone's share is made anew."""
    there = F.array_contains(people, person)
    return split_evenly_with_me(amount, F.when(there, F.array_remove(people, person)).otherwise(F.array_append(people, person)))


def my_share(amount: Column, lent: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), amount - F.coalesce(lent, F.lit(0)))


def outstanding_balances(splits: DataFrame) -> DataFrame:
    """(user_id, person_id, net_paise) of what is unsettled; who is square is left out. Positive is owed to the user."""
    signed = F.when(F.col("direction") == "owed_to_me", F.col("amount_paise")).otherwise(-F.col("amount_paise"))
    return splits.filter("settled_at_ms is null").groupBy("user_id", "person_id").agg(F.sum(signed).alias("net_paise")).filter("net_paise != 0")


def total_outstanding(splits: DataFrame) -> DataFrame:
    """(user_id, owed_to_me, i_owe) over the net balance with each person."""
    net = F.col("net_paise")
    part = lambda test, value, name: F.sum(F.when(test, value).otherwise(0)).alias(name)
    return outstanding_balances(splits).groupBy("user_id").agg(part(net > 0, net, "owed_to_me"), part(net < 0, -net, "i_owe"))


def replace_splits(splits: DataFrame, new: DataFrame) -> DataFrame:
    """The splits with those of the payments in `new` (user_id, transaction_id, person_id, direction, amount_paise) replaced.

    Shares of nothing are dropped, and stand for a payment that is no longer shared; a share of the same person and direction stays settled when it was, at the latest of its times.
    """
    key = ["user_id", "transaction_id"]
    kept = splits.join(new.select(*key).distinct(), key, "left_anti")
    was = splits.groupBy(*key, "person_id", "direction").agg(F.max("settled_at_ms").alias("settled_at_ms"))
    made = new.filter("amount_paise > 0").join(was, [*key, "person_id", "direction"], "left")
    return kept.unionByName(made.select(*kept.columns))


def settle_up(splits: DataFrame, people: DataFrame, now_ms: int) -> DataFrame:
    """The splits with all that is open with the given (user_id, person_id) settled now; what was settled before keeps its time."""
    done = people.select("user_id", "person_id").distinct().withColumn("__now", F.lit(now_ms).cast("long"))
    return splits.join(done, ["user_id", "person_id"], "left").withColumn("settled_at_ms", F.coalesce("settled_at_ms", "__now")).drop("__now")


def split_with_person(splits: DataFrame, people: DataFrame) -> DataFrame:
    return splits.join(people.select("user_id", F.col("id").alias("person_id"), F.col("name").alias("person_name")), ["user_id", "person_id"])


def deletable_people(people: DataFrame, splits: DataFrame) -> DataFrame:
    """The people with whom their user has nothing unsettled."""
    open_ = splits.filter("settled_at_ms is null").select("user_id", F.col("person_id").alias("id")).distinct()
    return people.join(open_, ["user_id", "id"], "left_anti")
