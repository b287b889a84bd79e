"""Whole flows, from raw input to the next version of the ledger: messages that wait in the queue, and statement files.

A ledger row has user_id, id, account_id, amount_paise, direction, title, merchant, category, occurred_at_ms, source, status, raw_sender, raw_body, dedup_key and reference, and as it likes
confidence (how sure the parse is; of statement rows 1, or 0.6 without a merchant) and note (the user's own, null in new rows).
What a flow decides is written to the shared folder before it is used, as several results read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.messages import capture_origin, parse_captures
from ..sources.captures import DRAIN_ROWS, drain_pending, mark_consumed
from ..sources.files import format_of, read_delimited
from ..sources.shared import written
from ..streaming.index import MatchIndex
from .accounts import is_self_transfer, new_accounts, resolve_account_last4, resolve_account_mask
from .dedup import collapse_batch, find_duplicate, import_report, merge_statement
from .ledger import new_id, upsert
from .rules import Keywords, suggest_category
from .statements import detect_wallet_statement, parse_wallet_statement, table_rows

OWN_TRANSFER = "Transfers"
#: Confidence of statement rows without and with a merchant.
UNSURE = (0.6, 1.0)


@dataclass
class Drained:
    """`report` has a row per user: messages imported and skipped."""

    ledger: DataFrame
    accounts: DataFrame
    consumed: DataFrame
    report: DataFrame


@dataclass
class Imported:
    """`report` has a row per file: rows imported, duplicates, replaced and unparsed."""

    ledger: DataFrame
    accounts: DataFrame
    report: DataFrame


def ledger_rows(captures: DataFrame, ledger: DataFrame | MatchIndex) -> DataFrame:
    """New pending rows of one batch of messages: parsed, not in the ledger by any layer, and not twice in the batch. Newest first decides. The ledger is a table, or a standing index of one."""
    parsed = written(parse_captures(captures).withColumn("origin", capture_origin(F.col("source"), F.col("sender"))), "parsed")
    keys = ledger.held_keys(parsed) if isinstance(ledger, MatchIndex) else ledger.select("user_id", "dedup_key")
    fresh = written(parsed.join(keys, ["user_id", "dedup_key"], "left_anti"), "unknown-keys")
    found = ledger.find_duplicate(fresh) if isinstance(ledger, MatchIndex) else find_duplicate(fresh, ledger)
    fresh = written(fresh.join(found.select("user_id", F.col("incoming_id").alias("id")), ["user_id", "id"], "left_anti"), "unmatched")
    again = collapse_batch(fresh, [-F.col("posted_at_ms"), -F.col("id")]).filter("match_id is not null").select("user_id", "id")
    rows = fresh.join(again, ["user_id", "id"], "left_anti")
    return rows.withColumn("status", F.lit("pending")).withColumn("raw_sender", F.col("sender")).withColumn("raw_body", F.col("body"))


def pending_rows(captures: DataFrame, ledger: DataFrame | MatchIndex, accounts: DataFrame, rules: DataFrame, keywords: Keywords) -> tuple[DataFrame, DataFrame]:
    """New ledger rows of a batch of messages, with account and category, and the accounts to make for them (user_id, id, name, last4, kind, archived).

    Transfers between a user's own accounts are judged by the accounts that were the user's before the message, and are categorised as such.
    """
    rows = written(ledger_rows(captures, ledger), "new-rows")
    placed = resolve_account_last4(rows, accounts)
    made = new_accounts(placed).select("user_id", new_id("user_id", "last4").alias("id"), "name", "last4", "kind", F.lit(False).alias("archived"))
    own = is_self_transfer(rows, accounts).withColumn("own", F.lit(True))
    account = F.coalesce("account_id", F.when(F.col("last4").isNotNull(), new_id("user_id", "last4")))
    named = suggest_category(placed.withColumn("account_id", account).withColumn("title", F.lit(None).cast("string")), rules, keywords)
    told = named.join(own, ["user_id", "id"], "left").withColumn("category", F.when(F.col("own"), OWN_TRANSFER).otherwise(F.col("suggested")))
    return told.withColumn("id", new_id("user_id", "dedup_key")), made


def like_ledger(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """`rows` with the ledger's columns, null where they have none."""
    kinds = {f.name: f.dataType for f in ledger.schema}
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ledger.columns])


def drain_batch(captures: DataFrame, consumed: DataFrame, ledger: DataFrame, accounts: DataFrame, rules: DataFrame, keywords: Keywords, most: int = DRAIN_ROWS) -> Drained:
    """Each user's newest waiting messages read into the ledger. Running it again over its own results changes nothing."""
    drained = written(drain_pending(captures, consumed, most).drop("row_no"), "drained")
    rows, made = pending_rows(drained, ledger, accounts, rules, keywords)
    rows = written(like_ledger(rows, ledger), "pending-rows")
    seen = drained.groupBy("user_id").agg(F.count("*").alias("seen"))
    taken = rows.groupBy("user_id").agg(F.count("*").alias("imported"))
    imported = F.coalesce("imported", F.lit(0))
    report = seen.join(taken, "user_id", "left").select("user_id", imported.alias("imported"), (F.col("seen") - imported).alias("skipped"))
    return Drained(upsert(ledger, rows), accounts.unionByName(made.select(*accounts.columns)), mark_consumed(consumed, drained), report)


def read_statements(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statement rows of (user_id, file_id, content), with fmt and an id in file order, and (user_id, file_id, skipped). File ids are unique.

    What a file is, its content tells: a wallet's text, else a delimited table. Files that are neither have no rows.
    """
    named = files.select(F.col("file_id").cast("string").alias("file_id"), "user_id", "content", format_of(F.col("content")).alias("format"))
    text = F.decode("content", "UTF-8")
    named = named.withColumn("wallet", detect_wallet_statement(text))
    tables = table_rows(read_delimited(named.filter("not wallet and format = 'delimited'"))).withColumn("fmt", F.lit("table"))
    wallets = parse_wallet_statement(named.filter("wallet").select("file_id", text.alias("text"))).withColumn("ok", F.col("amount_paise").isNotNull()).withColumn("fmt", F.lit("phonepe"))
    every = written(tables.unionByName(wallets).join(files.select(F.col("file_id").cast("string").alias("file_id"), "user_id"), "file_id"), "statement-rows")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("file_id", "row_idx")).cast("long")
    return every.filter("ok").withColumn("id", place), every.groupBy("user_id", "file_id").agg(F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("long").alias("skipped"))


def import_statements(files: DataFrame, ledger: DataFrame, accounts: DataFrame, rules: DataFrame, keywords: Keywords) -> Imported:
    """Statement files (user_id, file_id, content) merged into the ledger: rows it lacks are added, pending rows that a statement knows better are replaced."""
    rows, skipped = read_statements(files)
    decisions = written(merge_statement(rows, ledger, F.col("fmt")), "decisions")
    taken = rows.join(decisions.filter("decision != 'duplicate'").select("user_id", "id", "dedup_key"), ["user_id", "id"])
    placed = resolve_account_mask(taken, accounts).withColumn("last4", F.when(F.length("digits") == 4, F.col("digits")))
    made = placed.filter("new_name is not null").groupBy("user_id", F.col("new_name").alias("name")).agg(F.min("last4").alias("last4"), F.min("new_kind").alias("kind"))
    made = made.select("user_id", new_id("user_id", "name").alias("id"), "name", "last4", "kind", F.lit(False).alias("archived"))
    account = F.coalesce("account_id", F.when(F.col("new_name").isNotNull(), new_id("user_id", "new_name")))
    told = placed.withColumn("account_id", account).withColumn("raw_body", F.col("raw_line")).withColumn("title", F.lit(None).cast("string"))
    named = suggest_category(told, rules, keywords).withColumn("category", F.col("suggested")).withColumn("id", new_id("user_id", "dedup_key"))
    named = named.withColumn("confidence", F.when(F.col("merchant").isNotNull(), UNSURE[1]).otherwise(UNSURE[0]))
    named = named.withColumn("source", F.lit("manual")).withColumn("status", F.lit("pending")).withColumn("raw_sender", F.concat(F.lit("statement:"), F.col("fmt")))
    gone = decisions.filter("deletes").select("user_id", F.col("ledger_id").alias("id"))
    return Imported(upsert(ledger, like_ledger(named, ledger), deletes=gone), accounts.unionByName(made.select(*accounts.columns)), import_report(decisions, skipped))
