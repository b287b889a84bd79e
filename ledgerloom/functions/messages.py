"""Bank and payment-app messages read into typed columns, all with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import DAY_MS, NOON_MS, blank_to_null, bound_group, day_of, let, ms_of, paise, squeezed, title_case

# Patterns and word lists that results depend on. A pattern begins with the letters that a match can begin with, `(?=[...])`: it changes no match, and most places are
# passed over by one look, where an alternation tries all its words.
NUMBER = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
CURRENCY = r"(?:rs\.?|inr|₹)"
DEBIT_WORDS = "debited|debit|spent|paid|withdrawn|purchase|deducted|sent|transferred"
CREDIT_WORDS = "credited|credit|received|refund|refunded|deposited|cashback|salary"
MOVEMENT_WORDS = "debited|debit|credited|credit|spent|paid|withdrawn|purchase|deducted|sent|transferred|received|refund|refunded|deposited|transaction|txn"
NOISE_WORDS = (
    "otp|one[- ]time password|verification code|do not share|dont share|will expire|pre-?approved|loan offer|apply now|cashback offer|statement is ready"
    "|e-?mandate|autopay reminder|failed|declined|reversed|unsuccessful"
)
MASKED = r"(?=[x*•])\b(?:x{2,}|\*{2,}|•{2,})\s*(\d{4})\b"
LABELLED = r"(?=[acv])(?:a/c|ac|acct|account|card|vpa)[^0-9a-z]{0,12}?(?:no\.?|ending|ending in)?[^0-9]{0,6}(\d{4})\b"
NAMED_DATE = r"(?=\d)\b(\d{1,2})[-\s]([A-Za-z]{3})[a-z]*[-\s'](\d{2,4})\b"
NUMERIC_DATE = r"(?=\d)\b(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})\b"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MERCHANTS = (
    r"(?i)(?=i)\binfo:?\s*(?:upi|imps|neft|ach|mmt)?[/\-]?[a-z0-9]*[/\-]([A-Za-z0-9&\- ']{3,40})",
    r"(?i)(?=v)\bvpa\s+([a-z0-9._\-]+)@[a-z]+",
    r"(?i)(?=[atbf])\b(?:at|to|towards|by|from)\s+([A-Za-z0-9][A-Za-z0-9&\-_ ']{2,40})",
    r"(?=\d)\b\d{1,2}[-/][A-Za-z0-9]{2,3}[-/]\d{2,4}\s+([A-Z][A-Z0-9&\-']+(?:\s+[A-Z][A-Z0-9&\-']+)*)",
    r"(?i)(?=[psr])\b(?:paid to|sent to|received from)\s+([A-Za-z0-9][A-Za-z0-9&\-_ ']{2,40})",
)
JUNK_TAIL = r"(?i)(?=[ablrincutod])\b(avl|avlbl|available|bal|balance|lmt|limit|ref|refno|info|not you|call|upi|txn|a/c|on|dated|inr|rs|card|ac)\b.*$"
STOPWORDS = "your you the a an account card bank upi vpa ref avl bal balance limit info txn transaction".split()
REFERENCES = (
    r"(?i)(?=[uinr])\b(?:upi|imps|neft|rtgs)\s*[/\-:]\s*(?:(?:dr|cr|p2a|p2m)\s*[/\-:]\s*)?([A-Za-z0-9]{6,})",
    r"(?i)(?=r)\brrn\s*:?\s*([A-Za-z0-9]{6,})",
    r"(?i)(?=t)\b(?:txn|transaction)\s*(?:id|no\.?)\s*:?\s*([A-Za-z0-9]{6,})",
    r"(?i)(?=r)\bref(?:erence)?\s*(?:no\.?|number)?\s*:?\s*([A-Za-z0-9]{6,})",
    r"(?i)(?=u)\butr\s*(?:no\.?)?\s*:?\s*([A-Za-z0-9]{6,})",
)
#: A date further than this from the message is not believed.
DATE_REACH_DAYS = 45


def words(names: str) -> str:
    return rf"(?i)(?=[{''.join(sorted({w[0] for w in names.split('|')}))}])\b(?:{names})\b"


def is_noise(text: Column) -> Column:
    return text.rlike(words(NOISE_WORDS))


def has_movement(text: Column) -> Column:
    return text.rlike(words(MOVEMENT_WORDS))


def extract_amount(text: Column) -> Column:
    """struct(paise, at): the first amount behind a currency, else before one, and the characters before its match."""

    def found(match: Column, before: Column) -> Column:
        value = paise(blank_to_null(F.regexp_extract(match, NUMBER, 1)))
        return let(value, lambda v: F.when(v.isNotNull(), F.struct(v.alias("paise"), before.alias("at"))))

    def behind() -> Column:
        """The match's own text stands nowhere before it: there it would have matched already."""
        return let(F.regexp_extract(text, rf"(?i)(?=[ri₹]){CURRENCY}\s*{NUMBER}", 0), lambda m: F.when(m != "", found(m, F.instr(text, m) - 1)))

    def ahead() -> Column:
        whole = rf"(?is)^(.*?)\b({NUMBER}\s*{CURRENCY})"
        return let(F.regexp_extract(text, whole, 2), lambda m: F.when(m != "", found(m, F.length(F.regexp_extract(text, whole, 1)))))

    return F.coalesce(behind(), ahead())


def extract_direction(text: Column, at: Column) -> Column:
    """The direction whose nearest word is nearer to the amount; a tie is a debit, no word at all is null.

    One character more than the text before the amount is kept, so a word that runs into it is not taken for whole.
    """
    before, after = F.substr(text, F.lit(1), at + 1), F.substr(text, at + 1)

    def distance(names: str) -> Column:
        last = at - F.length(F.regexp_extract(before, rf"(?is)^(.*)\b(?:{names})\b", 1))  # only looked for where there is one
        first = F.regexp_instr(after, F.lit(words(names))) - 1
        return F.least(F.when(before.rlike(words(names)), last), F.when(first >= 0, first))

    def told(d: Column) -> Column:
        return F.when(d["credit"].isNull() & d["debit"].isNull(), None).when(d["debit"].isNull() | (d["credit"] < d["debit"]), "credit").otherwise("debit")

    return let(F.struct(distance(DEBIT_WORDS).alias("debit"), distance(CREDIT_WORDS).alias("credit")), told)


def extract_last4(text: Column) -> Column:
    return F.coalesce(bound_group(text, "(?i)" + MASKED), bound_group(text, "(?i)" + LABELLED))


def extract_all_last4(text: Column) -> Column:
    """Every quoted account number in text order, each once; both forms end with the digits."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){MASKED}|{LABELLED}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.right(m, F.lit(4))))


def extract_merchant(text: Column) -> Column:
    def cut(raw: Column) -> Column:
        value = F.regexp_replace(squeezed(raw), r"^(.+?)[.;!?](?:\s|$).*$", "$1")
        value = F.trim(F.regexp_replace(value, JUNK_TAIL, ""))
        value = F.trim(F.regexp_replace(value, r"\s+[A-Za-z]$", ""))
        return F.trim(F.regexp_replace(value, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))

    def named(value: Column) -> Column:
        good = (F.length(value) >= 3) & ~value.rlike(r"^\d+$") & ~F.lower(value).isin(STOPWORDS)
        return F.when(good & (value == F.upper(value)) & (F.length(value) > 3), title_case(value)).when(good, value)

    # a later pattern is only tried where the earlier ones give no name
    return F.coalesce(*[let(let(bound_group(text, p), cut), named) for p in MERCHANTS])


def _dated(day: Column, month: Column, year: Column, posted_ms: Column) -> Column:
    """Noon of the day, the posting time itself if it is the same day, null if out of range. A day past the month's end runs into the next."""

    def at(v: Column) -> Column:
        full = F.when(v["y"] < 100, v["y"] + 2000).otherwise(v["y"])
        return F.when(v["m"].between(1, 12) & v["d"].between(1, 31), F.date_add(F.make_date(full, v["m"], F.lit(1)), v["d"] - 1))

    def believed(date: Column) -> Column:
        noon = ms_of(date, NOON_MS)
        return F.when(F.abs(noon - posted_ms) > DATE_REACH_DAYS * DAY_MS, None).when(date == day_of(posted_ms), posted_ms).otherwise(noon)

    return let(let(F.struct(day.alias("d"), month.alias("m"), year.alias("y")), at), believed)


def extract_occurred_at(text: Column, posted_ms: Column) -> Column:
    number = lambda pattern, group: bound_group(text, pattern, group).try_cast("int")
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(bound_group(text, NAMED_DATE, 2))), F.lit(0)).cast("int")
    named = _dated(number(NAMED_DATE, 1), month, number(NAMED_DATE, 3), posted_ms)
    numeric = _dated(number(NUMERIC_DATE, 1), number(NUMERIC_DATE, 2), number(NUMERIC_DATE, 3), posted_ms)
    return F.coalesce(F.when(text.rlike(NAMED_DATE), named), F.when(text.rlike(NUMERIC_DATE), numeric), posted_ms)


def extract_reference(text: Column) -> Column:
    return F.coalesce(*[bound_group(text, p) for p in REFERENCES])


def parse_confidence(merchant: Column, last4: Column) -> Column:
    tenths = F.lit(5) + F.when(merchant.isNotNull(), 3).otherwise(0) + F.when(last4.isNotNull(), 2).otherwise(0)
    return tenths.cast("double") / 10


def text_hash(text: Column) -> Column:
    """The 33-times hash of the characters, 32 bits unsigned, in base 36."""
    step = lambda h, c: F.when(c == "", h).otherwise((h * 33 + F.ascii(c)).bitwiseAND(F.lit(2**32 - 1)))
    return F.lower(F.conv(F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), step).cast("string"), 10, 36))


def capture_key(source: Column, sender: Column, posted_ms: Column, body: Column) -> Column:
    return F.concat_ws("|", source, sender, posted_ms.cast("string"), text_hash(body))


def merchant_identity(merchant: Column, least: int = 3) -> Column:
    bare = F.regexp_replace(F.lower(merchant), "[^a-z0-9]", "")
    return F.when(F.length(bare) >= least, bare)


def capture_origin(source: Column, raw_sender: Column) -> Column:
    return F.when(raw_sender.startswith("statement:"), "statement").when(source.isin("sms", "notification"), source).otherwise("manual")


# What an origin is called.
BADGES = {"sms": "SMS", "notification": "NOTIF", "statement": "PDF", "manual": "MANUAL"}
DESCRIPTIONS = {
    "sms": "Read from a bank SMS",
    "notification": "Read from a payment app notification",
    "statement": "Imported from a statement PDF",
    "manual": "Entered by hand",
}


def _named(names: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[key]


def origin_badge(origin: Column) -> Column:
    return _named(BADGES, origin)


def origin_description(origin: Column) -> Column:
    return _named(DESCRIPTIONS, origin)


def payment_reference(reference: Column, dedup_key: Column) -> Column:
    whole = "^[A-Za-z0-9]{6,}$"
    third = F.when(dedup_key.startswith("stmt|"), F.get(F.split(dedup_key, r"\|"), F.lit(2)))
    return F.coalesce(F.when(reference.rlike(whole), reference), F.when(third.rlike(whole), third))


def display_title(title: Column, merchant: Column, fallback: str = "Unknown") -> Column:
    return F.coalesce(blank_to_null(F.trim(title)), blank_to_null(F.trim(merchant)), F.lit(fallback))


def moved(text: Column) -> Column:
    """struct(amount_paise, direction) of a squeezed message; its direction is null if it reports no payment."""
    direction = lambda a, t: F.when(a.isNotNull(), extract_direction(t, a["at"]))
    return let(text, lambda t: let(extract_amount(t), lambda a: F.struct(a["paise"].alias("amount_paise"), direction(a, t).alias("direction"))))


def parse_captures(captures: DataFrame) -> DataFrame:
    """Typed rows of the messages (id, user_id, source, sender, body, posted_at_ms) that report a payment; other messages go.

    One narrow pass: the cheap word tests are filters before the pattern work. What tells a payment is read once: the generator of one row keeps the
    optimiser from moving the filter on it below, where it would repeat the patterns. So it is with the body, which may be made by an expression, and with the squeezed text.
    The other fields are columns of their own, so those that a job doesn't use are not read.
    """
    once = lambda c: F.explode(F.array(c))
    kept = ["id", "user_id", "source", "sender", "posted_at_ms"]
    bound = captures.select(*kept, once("body").alias("body")).select(*kept, "body", once(squeezed(F.col("body"))).alias("text"))
    text = F.col("text")
    likely = bound.filter((text != "") & ~is_noise(text) & has_movement(text))
    kept = ["id", "user_id", "source", "sender", "body", "posted_at_ms"]
    paid = likely.select(*kept, "text", F.explode(F.array(moved(text))).alias("p")).filter("p.direction is not null")
    read = paid.select(
        *kept, "p.amount_paise", "p.direction", let(text, extract_last4).alias("last4"), let(text, extract_all_last4).alias("all_last4"), let(text, extract_merchant).alias("merchant"),
        let(text, lambda t: extract_occurred_at(t, F.col("posted_at_ms"))).alias("occurred_at_ms"), let(text, extract_reference).alias("reference"),
    )
    key = capture_key(F.col("source"), F.col("sender"), F.col("posted_at_ms"), F.col("body"))
    return read.select(
        *kept, "amount_paise", "direction", "last4", "all_last4", "merchant", "occurred_at_ms", parse_confidence(F.col("merchant"), F.col("last4")).alias("confidence"), "reference", key.alias("dedup_key"),
    )


def backfill_reference(ledger: DataFrame) -> DataFrame:
    """The ledger with references read from the raw body where none is stored."""
    return ledger.withColumn("reference", F.coalesce("reference", extract_reference(F.col("raw_body"))))


