"""When two records are one payment: tests as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
#: Within one source, and across sources.
TIGHT_MS, WIDE_MS = 10 * MINUTE_MS, 12 * 60 * MINUTE_MS
LEAST_REFERENCE, LEAST_MERCHANT = 6, 4


def bare_reference(reference: Column) -> Column:
    """The reference as it is compared: upper-case letters and digits, null when too short to tell."""
    bare = F.regexp_replace(F.upper(reference), "[^A-Z0-9]", "")
    return F.when(F.length(bare) >= LEAST_REFERENCE, bare)


def references_match(a: Column, b: Column) -> Column:
    """Equal, or one begins or ends with the other; on bare references."""
    return F.coalesce(a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a), F.lit(False))


def merchants_match(a: Column, b: Column) -> Column:
    """Equal identities, or one holds the other and both are long enough."""
    held = (F.least(F.length(a), F.length(b)) >= LEAST_MERCHANT) & (a.contains(b) | b.contains(a))
    return F.coalesce((a == b) | held, F.lit(False))


def is_same_payment(
    time_a: Column, merchant_a: Column, origin_a: Column, time_b: Column, merchant_b: Column, origin_b: Column, tight_ms: Column | int = TIGHT_MS, wide_ms: int = WIDE_MS
) -> Column:
    """For two records of one amount and direction. Near in time a missing merchant will do; further, another origin and a merchant match are needed."""
    apart = F.abs(time_a - time_b)
    match = merchants_match(merchant_a, merchant_b)
    near = merchant_a.isNull() | merchant_b.isNull() | match
    return F.when(apart <= tight_ms, near).otherwise((origin_a != origin_b) & (apart <= wide_ms) & match)
