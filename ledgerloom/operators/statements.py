"""Statement grids and wallet texts read into statement rows.

Grids are cells (file_id, row_idx, col_idx, cell). Statement rows have amount_paise, direction, merchant, occurred_at_ms, has_exact_time, account_mask, reference
and raw_line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.statements import COLUMN_SYNONYMS, narration_merchant, narration_reference, normal_header, parse_table_date, row_direction_amount
from ..functions.text import NOON_MS, blank_to_null, first_group, first_present, let, ms_of, paise, squeezed, title_case

HEADER_ROWS = 80
LONG_NUMBER = r"\b(\d{9,20})\b"
ROLES = list(COLUMN_SYNONYMS)
#: All synonyms of a date hold it in one word, which normalising a heading neither makes nor breaks.
DATE_WORD = "date"


def _roles(heads: Column) -> Column:
    """struct of a column number or null per role, for headings as an array of (col, head). An exact heading beats one that only holds a synonym, an earlier synonym a later one."""

    def told(names: list[str]) -> Column:
        synonyms = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(names)])
        hits = lambda h: F.transform(F.filter(synonyms, lambda x: h["head"].contains(x["s"])), lambda x: F.struct((h["head"] != x["s"]).alias("partial"), x["i"].alias("i"), h["col"].alias("col")))
        return F.array_min(F.flatten(F.transform(heads, hits)))["col"]

    return F.struct(*[told(names).alias(role) for role, names in COLUMN_SYNONYMS.items()])


def _headed(cells: DataFrame) -> DataFrame:
    """(file_id, row_idx, row, header): a grid row's cells in order, and the file's header_row and roles, null if it has none.

    The header is the richest of the first `HEADER_ROWS` rows that has a date and an amount, the first of equals. One exchange, by file.
    """
    rows = cells.repartition("file_id").groupBy("file_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "cell"))).alias("row"))
    # every heading of a date holds its word, so other rows, most of a short file, are not compared with the synonyms
    dated = F.exists("row", lambda c: F.lower(c["cell"]).contains(DATE_WORD))
    heads = F.when((F.col("row_idx") < HEADER_ROWS) & dated, F.transform("row", lambda c: F.struct(c["col_idx"].alias("col"), normal_header(c["cell"]).alias("head"))))
    found = rows.withColumn("heads", heads).withColumn("r", _roles(F.col("heads")))
    apart = lambda c, *others: F.when(~F.coalesce(*[F.when(F.col(c) == F.col(o), True) for o in others], F.lit(False)), F.col(c))
    told = found.select("file_id", "row_idx", "row", "r.*").withColumn("debit", apart("debit", "indicator")).withColumn("credit", apart("credit", "indicator"))
    told = told.withColumn("amount", apart("amount", "debit", "credit"))
    usable = F.col("date").isNotNull() & F.coalesce("debit", "credit", "amount").isNotNull()
    score = sum((F.col(r).isNotNull().cast("int") for r in ROLES), F.lit(0))
    best = F.max_by(F.struct(F.col("row_idx").alias("header_row"), *ROLES), F.when(usable, F.struct(score, -F.col("row_idx")))).over(W.partitionBy("file_id"))
    return told.select("file_id", "row_idx", "row", best.alias("header"))


def detect_header(cells: DataFrame) -> DataFrame:
    """(file_id, header_row, and a column number or null per role) of the files that have a header."""
    return _headed(cells).filter(F.col("row_idx") == F.col("header.header_row")).select("file_id", "header.*")


def account_hint(cells: DataFrame, headers: DataFrame) -> DataFrame:
    """(file_id, account_mask): the last four of the first long digit run above the header."""
    run = first_group(F.regexp_replace("cell", r"\s", ""), LONG_NUMBER)
    above = cells.join(headers.select("file_id", "header_row"), "file_id").filter("row_idx < header_row").withColumn("run", run).filter("run is not null")
    return above.groupBy("file_id").agg(F.right(F.min_by("run", F.struct("row_idx", "col_idx")), F.lit(4)).alias("account_mask"))


def table_rows(cells: DataFrame) -> DataFrame:
    """Every grid row below its file's header, or of a file without one, read; `ok` tells transactions from what is skipped. One exchange, by file."""
    number = lambda c: first_group(F.regexp_replace(c["cell"], r"\s", ""), LONG_NUMBER)
    above = F.when(F.col("row_idx") < F.col("header.header_row"), first_present(F.transform("row", number)))
    headed = _headed(cells).withColumn("run", above)
    hint = F.min_by("run", F.when(F.col("run").isNotNull(), F.col("row_idx"))).over(W.partitionBy("file_id"))
    body = headed.withColumn("account_mask", F.right(hint, F.lit(4))).filter("header is null or row_idx > header.header_row")
    at = lambda role: F.get(F.filter("row", lambda c: c["col_idx"] == F.col(f"header.{role}")), F.lit(0))["cell"]
    rows = body.select("file_id", "row_idx", "row", "account_mask", *[F.trim(at(role)).alias(f"c_{role}") for role in ROLES])
    # the generator of one row keeps a filter on `ok` from being moved below, where it would read dates and amounts a second time
    read = F.struct(parse_table_date(F.col("c_date")).alias("at"), row_direction_amount(F.col("c_debit"), F.col("c_credit"), F.col("c_amount"), F.col("c_indicator")).alias("moved"))
    rows = rows.select("*", F.explode(F.array(read)).alias("read")).withColumn("occurred_at_ms", F.col("read.at")).withColumn("moved", F.col("read.moved"))
    narration = F.coalesce("c_description", F.lit(""))
    reference = F.coalesce(narration_reference(narration), F.when(F.col("c_reference").rlike("^[A-Za-z0-9]{6,}$"), F.col("c_reference")))
    whole = F.array_join(F.transform("row", lambda c: F.trim(c["cell"])), " ")
    return rows.select(
        "file_id", "row_idx", (F.col("occurred_at_ms").isNotNull() & F.col("moved").isNotNull()).alias("ok"), F.col("moved.amount_paise").alias("amount_paise"),
        F.col("moved.direction").alias("direction"), narration_merchant(narration).alias("merchant"), "occurred_at_ms", F.lit(False).alias("has_exact_time"), "account_mask",
        reference.alias("reference"), F.coalesce(blank_to_null(narration), whole).alias("raw_line"),
    )


def parse_table_statement(cells: DataFrame) -> DataFrame:
    return table_rows(cells).filter("ok").drop("ok")


def skipped_rows(cells: DataFrame) -> DataFrame:
    """(file_id, skipped): rows that are no transactions; a file without a header skips all its rows."""
    return table_rows(cells).groupBy("file_id").agg(F.sum(F.when(F.col("ok"), 0).otherwise(1)).cast("long").alias("skipped"))


# The line forms of wallet statements.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONEY = r"₹\s*([\d,]+(?:\.\d{1,2})?)"
DATE = r"^([A-Z][a-z]{2}) (\d{1,2}), (\d{4})$"
TIME = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)$"
TIME_ID = r"(?i)^(\d{1,2}):(\d{2})\s*(am|pm)\s+(?:Bharat Connect )?Transaction ID\s+(\S+)"
PAYMENT = rf"(?i)^(DEBIT|CREDIT)\s+{MONEY}\s*(?:\t|\s{{2,}})?(.*)$"
COMBINED = rf"^([A-Z][a-z]{{2}}) (\d{{1,2}}), (\d{{4}})\s+(.+?)\s+(?i:(DEBIT|CREDIT))\s+{MONEY}$"
TXN_ID, UTR, PAID_BY = r"(?i)^(?:Bharat Connect )?Transaction ID\s+(\S+)", r"(?i)^UTR No\.\s+(\S+)", r"(?i)^Paid by\s+(\S+)"
TYPE, AMOUNT, TYPE_AMOUNT = "(?i)^(DEBIT|CREDIT)$", rf"^{MONEY}$", rf"(?i)^(DEBIT|CREDIT)\s+{MONEY}$"
PREFIXES = r"(?i)^(paid to|received from|refund from|money sent to|money received from)\s+"


def detect_wallet_statement(text: Column) -> Column:
    return text.rlike("(?i)Transaction Statement for") & text.rlike(r"(?i)UTR No\.")


def _wallet_merchant(detail: Column) -> Column:
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(squeezed(detail), PREFIXES, "")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return let(bare, lambda v: F.when(F.length(v) < 2, None).when((v == F.upper(v)) & v.rlike("[A-Z]{3}"), title_case(v)).otherwise(v))


def _month_day(line: Column, pattern: str) -> Column:
    """Days since 1970 of a line's date, null if its month isn't one; a day past the month's end runs on."""
    part = lambda g: first_group(line, pattern, g)
    month = F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(1))), F.lit(0)).cast("int")
    return F.when(month.isNotNull(), ms_of(F.date_add(F.make_date(part(3).try_cast("int"), month, F.lit(1)), part(2).try_cast("int") - 1)))


def _clock(line: Column, pattern: str) -> Column:
    """Milliseconds since midnight."""
    part = lambda g: first_group(line, pattern, g)
    hour = part(1).try_cast("int") % 12 + F.when(F.lower(part(3)) == "pm", 12).otherwise(0)
    return (hour * 60 + part(2).try_cast("int")).cast("long") * 60_000


def reflowed_lines(texts: DataFrame) -> DataFrame:
    """(file_id, pos, line): trimmed lines, with type, amount and detail on one line whichever of the three layouts they came in."""
    lines = texts.select("file_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("line", F.trim(F.regexp_replace("line", r"[  \t\r]+$|^[  \t]+|[  ]", " ")))
    lines = lines.filter("line != ''")
    w = W.partitionBy("file_id").orderBy("pos")
    near = {k: F.coalesce((F.lead if k > 0 else F.lag)("line", abs(k)).over(w), F.lit("")) for k in (-2, -1, 1, 2)}
    around = lines.select("*", *[c.alias(f"l{k}".replace("-", "m")) for k, c in near.items()])
    meta = lambda c: c.rlike(TYPE) | c.rlike(DATE) | c.rlike(TIME) | c.rlike(TXN_ID) | c.rlike(UTR) | c.rlike(PAID_BY)
    detail = lambda c: (c != "") & ~meta(c)
    line, before2, before1, after1, after2 = (F.col(c) for c in ("line", "lm2", "lm1", "l1", "l2"))
    split3 = line.rlike(TYPE) & after1.rlike(AMOUNT)
    split2 = line.rlike(TYPE_AMOUNT) & detail(after1)
    used = before1.rlike(TYPE) & line.rlike(AMOUNT) | before2.rlike(TYPE) & before1.rlike(AMOUNT) & detail(line) | before1.rlike(TYPE_AMOUNT) & detail(line)
    joined = (
        F.when(split3, F.concat(F.upper(line), F.lit(" "), after1, F.lit("\t"), F.when(detail(after2), after2).otherwise("")))
        .when(split2, F.concat(line, F.lit("\t"), after1)).otherwise(line)
    )
    return around.filter(~used).select("file_id", "pos", joined.alias("line"))


def parse_wallet_statement(texts: DataFrame) -> DataFrame:
    """Statement rows of wallet texts (file_id, text), with row_idx. `amount_paise` is null for payments that are skipped.

    A running count numbers the payment that each line belongs to; a date line closes the one before. Windows are per file, one shuffle in all.
    """
    line = F.col("line")
    combined, date, payment = line.rlike(COMBINED), line.rlike(DATE), line.rlike(PAYMENT)
    kinds = reflowed_lines(texts).select(
        "file_id", "pos", "line", combined.alias("combined"), (payment & ~combined).alias("payment"),
        F.when(combined, _month_day(line, COMBINED)).when(date, _month_day(line, DATE)).alias("date_ms"), (date & ~combined).alias("dated"),
        F.when(line.rlike(TIME), _clock(line, TIME)).alias("time_ms"), F.when(line.rlike(TIME_ID), _clock(line, TIME_ID)).alias("time_id_ms"),
        F.coalesce(first_group(line, TIME_ID, 4), first_group(line, TXN_ID)).alias("txn_id"), first_group(line, UTR).alias("utr"), first_group(line, PAID_BY).alias("paid_by"),
    )
    upto = W.partitionBy("file_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(upto)
    opens = F.col("dated") & F.col("date_ms").isNotNull()
    placed = kinds.withColumn("row_idx", one(F.col("combined") | F.col("payment") | opens)).withColumn("day_no", one(F.col("combined") | opens))
    placed = placed.withColumn("day_ms", F.last("date_ms", True).over(upto))
    in_day = W.partitionBy("file_id", "day_no").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("pending_ms", F.last("time_ms", True).over(in_day))
    head = F.col("combined") | F.col("payment")
    rows = placed.groupBy("file_id", "row_idx").agg(
        F.max(F.when(head, F.struct("line", "combined", "day_ms", "pending_ms"))).alias("h"),
        F.min_by(F.coalesce("time_ms", "time_id_ms"), F.when(F.coalesce("time_ms", "time_id_ms").isNotNull(), F.col("pos"))).alias("own_ms"),
        F.min_by("txn_id", F.when(F.col("txn_id").isNotNull(), F.col("pos"))).alias("txn_id"), F.max_by("utr", F.when(F.col("utr").isNotNull(), F.col("pos"))).alias("utr"),
        F.max_by("paid_by", F.when(F.col("paid_by").isNotNull(), F.col("pos"))).alias("account_mask"),
    ).filter("h is not null")
    whole = F.col("h.line")
    pick = lambda a, b: F.when(F.col("h.combined"), first_group(whole, COMBINED, a)).otherwise(first_group(whole, PAYMENT, b))
    clock = F.coalesce(F.when(~F.col("h.combined"), F.col("h.pending_ms")), "own_ms")
    return rows.select(
        "file_id", "row_idx", F.when(F.col("h.day_ms").isNotNull(), paise(pick(6, 2))).alias("amount_paise"), F.lower(pick(5, 1)).alias("direction"),
        _wallet_merchant(F.coalesce(pick(4, 3), F.lit(""))).alias("merchant"), (F.col("h.day_ms") + F.coalesce(clock, F.lit(NOON_MS))).alias("occurred_at_ms"),
        clock.isNotNull().alias("has_exact_time"), "account_mask", F.coalesce("utr", "txn_id").alias("reference"), whole.alias("raw_line"),
    )


