"""Messages of many forms: each noise word, movement word, merchant, date, number and reference form, with what is to be read from it stated beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as m
from . import views as v
from .registry import query
from .views import _values, sql

NOISE = (
    "otp", "one time password", "one-time password", "verification code", "do not share", "dont share", "will expire", "preapproved", "pre-approved", "loan offer", "apply now", "cashback offer", "statement is ready",
    "emandate", "e-mandate", "autopay reminder", "failed", "declined", "reversed", "unsuccessful",
)
DEBITS = ("debited", "debit", "spent", "paid", "withdrawn", "purchase", "deducted", "sent", "transferred")
CREDITS = ("credited", "credit", "received", "refund", "refunded", "deposited")

#: (message, direction or none if it is no payment, merchant, whether its last four are read, whether its number is, its day: posted, three days before it, or the posting itself)
FORMS: list[tuple[str, str | None, str | None, bool, bool, str]] = [
    *[(f"Rs.{{amount}} debited via net {w}", None, None, False, False, "posted") for w in NOISE],
    ("Rs.{amount} due via net", None, None, False, False, "posted"), ("You paid via net", None, None, False, False, "posted"), ("Rs.0.00 debited via net", None, None, False, False, "posted"),
    *[(f"INR {{amount}} {w} via net", "debit", None, False, False, "posted") for w in DEBITS], *[(f"INR {{amount}} {w} via net", "credit", None, False, False, "posted") for w in CREDITS],
    ("transaction: cashback of ₹{amount}", "credit", None, False, False, "posted"), ("txn: salary ₹ {amount}", "credit", None, False, False, "posted"), ("txn of {amount} INR debited", "debit", None, False, False, "posted"),
    ("refund due; paid Rs {amount} via net", "debit", None, False, False, "posted"), ("paid once; refund Rs {amount} via net", "credit", None, False, False, "posted"),
    ("Rs.{amount} debited. Info: UPI/{number}/BIG BAZAAR", "debit", "Big Bazaar", False, True, "posted"), ("Rs.{amount} paid using VPA corner.store@okbank", "debit", "corner.store", False, False, "posted"),
    ("Rs.{amount} spent at Corner Shop. Thanks", "debit", "Corner Shop", False, False, "posted"), ("Rs.{amount} sent to Asha Rao Avl bal 99", "debit", "Asha Rao", False, False, "posted"),
    ("Rs.{amount} paid towards HOME LOAN 7", "debit", "Home Loan 7", False, False, "posted"), ("Rs.{amount} received from Asha Rao", "credit", "Asha Rao", False, False, "posted"),
    ("Rs.{amount} withdrawn by Ravi Kumar on demand", "debit", "Ravi Kumar", False, False, "posted"), ("Rs.{amount} spent at 12345", "debit", None, False, False, "posted"), ("Rs.{amount} spent at the", "debit", None, False, False, "posted"),
    ("Rs.{amount} debited: {named} BIG STORE", "debit", "Big Store", False, False, "before"), ("Rs.{amount} debited on {named}", "debit", None, False, False, "before"), ("Rs.{amount} debited on {numeric}", "debit", None, False, False, "before"),
    ("Rs.{amount} debited on {today}", "debit", None, False, False, "posted"), ("Rs.{amount} debited on {old}", "debit", None, False, False, "posted"),
    *[(f"Rs.{{amount}} debited {x}", "debit", None, False, True, "posted") for x in ("IMPS/P2A/{number}", "NEFT-{number}", "RTGS: {number}", "UPI:DR:{number}", "UPI/CR/{number}", "RRN: {number}", "txn id: {number}", "transaction no. {number}", "Reference number {number}", "Ref {number}", "UTR no {number}")],
    *[(f"Rs.{{amount}} debited from {x}", "debit", None, True, False, "posted") for x in ("A/c XX{last4}", "A/c **{last4}", "A/c ••{last4}", "a/c no. {last4}")], ("Rs.{amount} spent on card ending {last4}", "debit", None, True, False, "posted"),
]


def form_captures(spark, sf_dir: str) -> DataFrame:
    """A message for each event, of the form that its id picks."""
    e = v._event_rows(spark, sf_dir).filter("p > 0")
    posted = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("ms") / v.DAY_MS).cast("int"))
    before, old = F.date_sub(posted, 3), F.date_sub(posted, 60)
    names = {
        "amount": F.concat_ws(".", F.expr("p div 100"), F.lpad((F.col("p") % 100).cast("string"), 2, "0")), "number": (500000000000 + F.col("event_id")).cast("string"), "last4": (1000 + F.col("event_id") % 9000).cast("string"),
        "named": F.date_format(before, "dd-MMM-yy"), "numeric": F.date_format(before, "dd/MM/yyyy"), "today": F.date_format(posted, "d-M-yyyy"), "old": F.date_format(old, "dd-MMM-yyyy"),
    }
    body = v.one_of(F.col("event_id") % len(FORMS), [f[0] for f in FORMS])
    for name, value in names.items():
        body = F.replace(body, F.lit("{" + name + "}"), value)
    return e.select(F.col("event_id").alias("id"), "user_id", F.lit("sms").alias("source"), F.lit("BANK").alias("sender"), body.alias("body"), F.col("ms").alias("posted_at_ms"))


@query(
    "message_forms",
    sql(
        f"""SELECT e.event_id AS id, p AS amount_paise, direction, merchant, CASE WHEN has_last4 THEN CAST(1000 + event_id % 9000 AS VARCHAR) END AS last4, CASE WHEN has_number THEN CAST(500000000000 + event_id AS VARCHAR) END AS reference,
  CASE day WHEN 'before' THEN (ms // 86400000 - 3) * 86400000 + 43200000 ELSE ms END AS occurred_at_ms, (5 + CASE WHEN merchant IS NULL THEN 0 ELSE 3 END + CASE WHEN has_last4 THEN 2 ELSE 0 END) / 10.0::DOUBLE AS confidence
FROM {v._EVENTS} e JOIN forms f ON f.form = e.event_id % {len(FORMS)} WHERE p > 0 AND direction IS NOT NULL""",
        f"forms(form, direction, merchant, has_last4, has_number, day) AS (VALUES {_values([(i, *f[1:]) for i, f in enumerate(FORMS)])})",
    ),
)
def message_forms(spark, sf_dir):
    return m.parse_captures(form_captures(spark, sf_dir)).select("id", "amount_paise", "direction", "merchant", "last4", "reference", "occurred_at_ms", "confidence")
