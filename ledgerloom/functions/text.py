"""Small column helpers shared by the ledger functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
NOON_MS = 43_200_000


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def squeezed(text: Column) -> Column:
    """White space, the no-break space included, squeezed to one space and trimmed."""
    odd = text.contains("  ") | text.rlike(r"[\t\n\x0B\f\r\u00a0]")  # few texts need the replacement, which builds a string anew
    return F.trim(F.when(odd, F.regexp_replace(text, r"[\s\u00a0]+", " ")).otherwise(text))


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return blank_to_null(F.regexp_extract(text, pattern, group))


def let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once a row."""
    return F.transform(F.array(value), body)[0]


def bound_group(text: Column, pattern: str, group: int = 1) -> Column:
    """`first_group` for use in a lambda, where the optimiser can't bind the value that `nullif` names twice, and would look for the pattern twice."""
    return let(F.regexp_extract(text, pattern, group), lambda v: F.when(v != "", v))


def first_present(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def title_case(text: Column) -> Column:
    return F.array_join(F.transform(F.split(F.lower(text), " "), lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), " ")


def day_of(ms: Column) -> Column:
    """The calendar day of a wall-clock time in milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / DAY_MS).cast("int"))


def ms_of(day: Column, at: int = 0) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS + at


def paise(number_text: Column) -> Column:
    """A plain decimal text as whole paise, null unless it is above zero."""
    value = (F.regexp_replace(number_text, ",", "").try_cast("decimal(24,4)") * 100).cast("decimal(24,0)").try_cast("long")
    return let(value, lambda v: F.when(v > 0, v))
