"""Cells and narrations of bank statements read into typed columns, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .messages import merchant_identity
from .text import NOON_MS, blank_to_null, let, ms_of, squeezed, title_case

# Names of months, and what a statement calls its columns and rails.
MONTHS = {m: i % 12 + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())} | {"sept": 9}
COLUMN_SYNONYMS = {
    "date": ["transaction date", "txn date", "tran date", "posting date", "post date", "date of transaction", "value date", "date"],
    "description": ["transaction remarks", "transaction details", "transaction description", "narration", "particulars", "description", "remarks", "details", "narrative"],
    "debit": ["withdrawal amount", "withdrawal amt", "debit amount", "debit amt", "withdrawal", "withdrawals", "debit"],
    "credit": ["deposit amount", "deposit amt", "credit amount", "credit amt", "deposit", "deposits", "credit"],
    "amount": ["transaction amount", "amount", "amt"],
    "indicator": ["dr / cr", "dr/cr", "cr/dr", "debit/credit", "transaction type", "type", "indicator"],
    "reference": ["transaction id", "reference number", "reference no", "ref no", "utr", "utr no", "cheque number", "cheque no", "chq no", "reference"],
    "balance": ["closing balance", "available balance", "running balance", "balance"],
}
RAILS = (
    "upi imps neft rtgs ach achcr achdr mmt nach ecs inft bil bpay bbps atm pos vps ips cms onl".split()
    + ["payment fr", "pay to bha", "collect re", "transfer", "dr", "cr"]
)
DEBIT_SIGN, CREDIT_SIGN = r"(?i)^(dr|debit|withdrawal|w)$", r"(?i)^(cr|credit|deposit|d)$"
LAST_SERIAL = 100_000


def parse_loose_number(raw: Column) -> Column:
    """A number written for people, as a double: brackets or Dr for a negative, currency marks, either separator style; null if it isn't one.

    The texts are taken apart in steps, each on the one before: brackets, currency and spaces, sign, suffix, separators.
    """

    def signed(bare: Column) -> Column:
        # bare: currency and spaces gone; f: [text, "-" if negative]
        sign = F.when(bare.startswith("-"), "-").otherwise("")
        unsigned = F.regexp_replace(bare, r"^-?\+?", "")
        suffix = F.lower(F.regexp_extract(unsigned, "(?i)(cr|dr)$", 1))
        return F.array(F.regexp_replace(unsigned, "(?i)(cr|dr)$", ""), F.concat(sign, F.when(suffix == "dr", "-").otherwise("")))

    def number(x: Column) -> Column:
        comma, dot = F.length(x) - F.length(F.substring_index(x, ",", -1)), F.length(x) - F.length(F.substring_index(x, ".", -1))
        has_comma, has_dot = x.contains(","), x.contains(".")
        first_comma_to_dot = F.regexp_replace(x, r"^([^,]*),", "$1.")
        plain = (
            F.when(has_comma & has_dot & (comma > dot), F.regexp_replace(F.regexp_replace(x, r"\.", ""), r"^([^,]*),", "$1."))
            .when(has_comma & has_dot, F.regexp_replace(x, ",", ""))
            .when(has_comma & (F.length(x) - comma == 3), F.regexp_replace(x, ",", ""))
            .when(has_comma, first_comma_to_dot)
            .otherwise(x)
        )
        return F.when(x.rlike("[0-9]") & plain.rlike(r"^[0-9]*\.?[0-9]*$"), plain.try_cast("double"))

    trimmed = F.trim(raw)
    bracketed = trimmed.rlike(r"^\(.*\)$")
    inner = F.when(bracketed, F.regexp_replace(trimmed, r"^\(|\)$", "")).otherwise(trimmed)
    bare = F.regexp_replace(F.regexp_replace(inner, r"(?i)[₹$€£]|inr|rs\.?", ""), r"\s", "")
    return let(F.struct(bare.alias("b"), bracketed.alias("n")), lambda s: let(signed(s["b"]), lambda f: F.when(s["n"] | (f[1] != ""), -number(f[0])).otherwise(number(f[0]))))


def _built(day: Column, month: Column, year: Column) -> Column:
    """Noon of a real day from 1970 to 2200, else null."""
    full = F.when(year < 100, F.when(year > 70, year + 1900).otherwise(year + 2000)).otherwise(year)
    good = month.between(1, 12) & day.between(1, 31) & full.between(1970, 2200)
    first = F.when(good, F.make_date(full, month, F.lit(1)))
    return F.when(day <= F.day(F.last_day(first)), ms_of(F.date_add(first, day - 1), NOON_MS))


def _month(name: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    low = F.lower(name)
    return F.coalesce(F.try_element_at(names, F.substr(low, F.lit(1), F.lit(4))), F.try_element_at(names, F.substr(low, F.lit(1), F.lit(3))))


def parse_table_date(raw: Column) -> Column:
    """Noon of a statement date in wall-clock milliseconds: day first, month by name, year first, or a spreadsheet serial."""
    text = F.trim(raw)
    return let(F.struct(text.alias("text"), F.regexp_extract(text, "^([^ T]*)", 1).alias("head")), lambda v: _table_date(v["text"], v["head"]))


def _table_date(text: Column, head: Column) -> Column:
    def read(value: Column, pattern: str, made) -> Column:
        """`made` of the three groups, which are only taken apart where the pattern fits, and once."""
        groups = F.struct(*[F.regexp_extract(value, pattern, g).alias(f"g{g}") for g in (1, 2, 3)])
        return F.when(value.rlike(pattern), let(groups, lambda v: made(v["g1"], v["g2"], v["g3"])))

    def built(day: Column, month: Column, year: Column) -> Column:
        return let(F.struct(day.alias("d"), month.alias("m"), year.alias("y")), lambda v: _built(v["d"], v["m"], v["y"]))

    number = lambda c: c.try_cast("int")
    dmy = lambda value: read(value, day_first, lambda a, b, c: built(number(a), _month(b), number(c)))
    mdy = lambda value: read(value, month_first, lambda a, b, c: built(number(b), _month(a), number(c)))

    day_first, month_first = r"^(\d{1,2})[-/ ]([A-Za-z]{3,9})[-/ ](\d{2,4})$", r"^([A-Za-z]{3,9})[-/ ](\d{1,2}),?[-/ ](\d{2,4})$"
    numeric = r"^(\d{1,4})[-/.](\d{1,2})[-/.](\d{2,4})$"
    serial = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.try_cast("double"))
    days = F.when((serial >= 1) & (serial <= LAST_SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))
    return F.coalesce(
        ms_of(days, NOON_MS),
        dmy(head), dmy(text), mdy(head), mdy(text),
        read(head, numeric, lambda a, b, c: F.when(F.length(a) == 4, built(number(c), number(b), number(a))).otherwise(built(number(a), number(b), number(c)))),
    )


def segments(narration: Column) -> Column:
    return F.transform(F.split(narration, "[/|]"), lambda s: F.trim(s))


def narration_reference(narration: Column) -> Column:
    """The first segment of twelve digits, else the longest of nine or more, the first of equals."""
    digits = F.filter(segments(narration), lambda s: s.rlike(r"^\d{9,}$"))
    twelve = F.get(F.filter(digits, lambda s: F.length(s) == 12), F.lit(0))
    longest = F.aggregate(digits, F.lit(""), lambda best, s: F.when(F.length(s) > F.length(best), s).otherwise(best))
    return F.coalesce(twelve, blank_to_null(longest))


def narration_merchant(narration: Column) -> Column:
    """The first segment that reads like a name, in title case if it shouts."""
    reads = lambda s: ~s.rlike(r"^\d+$") & ~s.contains("@") & ~s.rlike(r"^\d{1,2}:\d{2}(:\d{2})?$") & ~F.lower(s).isin(RAILS) & s.rlike("[A-Za-z]{3}")
    name = F.get(F.filter(F.transform(F.filter(segments(narration), reads), squeezed), lambda s: F.length(s) >= 3), F.lit(0))
    return let(name, lambda n: F.when((n == F.upper(n)) & (F.length(n) > 3), title_case(n)).otherwise(n))


def cell_amount(cell: Column) -> Column:
    return F.when(~F.trim(cell).isin("", "-", "--"), parse_loose_number(cell))


def row_direction_amount(debit: Column, credit: Column, amount: Column, indicator: Column) -> Column:
    """struct(direction, amount_paise) of a row's cells: the filled one of two columns, else the indicator, else the sign; null if nothing moved."""

    def told(v: Column) -> Column:
        cents = lambda x: F.round(F.abs(x) * 100).cast("long").alias("amount_paise")
        made = lambda way, x: F.struct(way.alias("direction"), cents(x))
        d, c, a, sign = v["d"], v["c"], v["a"], v["s"]
        way = F.when(sign.rlike(DEBIT_SIGN), "debit").when(sign.rlike(CREDIT_SIGN), "credit").when(a < 0, "debit").otherwise("credit")
        return F.when(F.abs(d) > 0, made(F.lit("debit"), d)).when(F.abs(c) > 0, made(F.lit("credit"), c)).when(a != 0, made(way, a))

    return let(F.struct(cell_amount(debit).alias("d"), cell_amount(credit).alias("c"), cell_amount(amount).alias("a"), F.trim(indicator).alias("s")), told)


def normal_header(cell: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(cell, F.lit("")))), r"\(.*?\)", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z/ ]", " "), r"\s+", " "))


def mask_digits(mask: Column) -> Column:
    return blank_to_null(F.regexp_replace(mask, r"\D", ""))


def statement_key(fmt: Column | str, reference: Column, occurred_at_ms: Column, amount_paise: Column, merchant: Column) -> Column:
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    blank = F.concat_ws("|", F.lit("stmt"), fmt, occurred_at_ms.cast("string"), amount_paise.cast("string"), F.coalesce(merchant_identity(merchant, 1), F.lit("x")))
    return F.when(reference.isNotNull(), F.concat_ws("|", F.lit("stmt"), fmt, reference)).otherwise(blank)
