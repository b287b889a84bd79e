"""Queries over statement files, cells and narrations. The SQL states what the written cells mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statements as s
from ..functions.text import day_of
from ..operators import statements as st
from ..sources import files, large_files
from ..sources.shared import shared_path
from . import views as v
from .registry import query
from .views import sql

WHOLE, REST = "(p // 100)", "lpad(CAST(p % 100 AS VARCHAR), 2, '0')"


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


@query(
    "parse_loose_number",
    sql(
        """SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN -p / 100.0 WHEN 1 THEN p / 100.0 WHEN 2 THEN p / 100.0 WHEN 3 THEN -p / 100.0 WHEN 4 THEN CAST(p // 100 AS DOUBLE)
  WHEN 5 THEN NULL WHEN 6 THEN (p // 100) + (p % 10) / 10.0 ELSE -p / 100.0 END AS number FROM (SELECT *, CAST(round(abs(c_acctbal) * 100) AS BIGINT) AS p FROM customer)"""
    ),
)
def parse_loose_number(spark, sf_dir):
    rows = v.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(F.abs("c_acctbal") * 100).cast("long").alias("p"))
    whole, rest = F.expr("p div 100"), F.lpad((F.col("p") % 100).cast("string"), 2, "0")
    forms = [
        F.concat(F.lit("("), grouped(whole), F.lit("."), rest, F.lit(")")), F.concat(F.lit("Rs. "), grouped(whole), F.lit("."), rest),
        F.concat(F.translate(grouped(whole), ",", "."), F.lit(","), rest), F.concat(grouped(whole), F.lit("."), rest, F.lit(" Dr")),
        F.concat(F.lit("₹ "), grouped(whole), F.lit(" Cr")), F.lit("NA"), F.concat(whole, F.lit(","), F.col("p") % 10), F.concat(F.lit(" -"), whole, F.lit("."), rest),
    ]
    raw = F.get(F.array(*forms), (F.col("id") % 8).cast("int"))
    return rows.select("id", s.parse_loose_number(raw).alias("number"))


@query("parse_table_date", sql("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE epoch_us(o_orderdate) // 1000 // 86400000 * 86400000 + 43200000 END AS at_ms FROM orders"))
def parse_table_date(spark, sf_dir):
    rows = v.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"))
    form = lambda f: F.date_format("d", f)
    serial = (F.datediff("d", F.lit("1899-12-30").cast("date"))).cast("string")
    forms = [form("dd/MM/yyyy"), form("d-MMM-yyyy"), form("MMM d, yyyy"), form("yyyy-MM-dd"), serial, F.concat(form("dd.MM.yy"), F.lit(" 10:30")), form("dd MMM yyyy"), F.concat(F.lit("32/"), form("MM/yyyy"))]
    return rows.select("id", s.parse_table_date(F.get(F.array(*forms), (F.col("id") % 8).cast("int"))).alias("at_ms"))


def narrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("id")
    forms = [
        F.concat(F.lit("UPI/SHOP "), key, F.lit(" LTD/x@bank/"), 300000000000 + key, F.lit("/ICI71")), F.concat(F.lit("ACHCR/MAHINDRA AND MAHINDR/25472751"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("/12345678901")),
        F.concat(F.lit("IMPS|123|10:20:30|Mixed  Case shop|"), key), F.lit("NEFT/DR/ab"),
    ]
    return v.transactions(spark, sf_dir).select("id", F.get(F.array(*forms), (key % 4).cast("int")).alias("narration"))


@query("narration_reference", sql("SELECT id, CASE id % 4 WHEN 0 THEN CAST(300000000000 + id AS VARCHAR) WHEN 1 THEN '12345678901' END AS reference FROM transactions"))
def narration_reference(spark, sf_dir):
    return narrations(spark, sf_dir).select("id", s.narration_reference(F.col("narration")).alias("reference"))


@query("narration_merchant", sql("SELECT id, CASE id % 4 WHEN 0 THEN 'Shop ' || id || ' Ltd' WHEN 1 THEN 'Mahindra And Mahindr' WHEN 2 THEN 'Mixed Case shop' END AS merchant FROM transactions"))
def narration_merchant(spark, sf_dir):
    return narrations(spark, sf_dir).select("id", s.narration_merchant(F.col("narration")).alias("merchant"))


@query(
    "row_direction_amount",
    sql("""SELECT id, CASE WHEN id % 6 = 5 THEN NULL WHEN id % 6 IN (0, 2, 4) THEN 'debit' ELSE 'credit' END AS direction, CASE WHEN id % 6 <> 5 THEN amount_paise END AS amount_paise FROM transactions"""),
)
def row_direction_amount(spark, sf_dir):
    text = F.concat_ws(".", F.expr("amount_paise div 100"), F.lpad((F.col("amount_paise") % 100).cast("string"), 2, "0"))
    none = F.lit(None).cast("string")
    pick = lambda *forms: F.get(F.array(*forms), (F.col("id") % 6).cast("int"))
    debit, credit = pick(text, F.lit("0.00"), none, none, none, F.lit("-")), pick(F.lit("-"), text, none, none, none, F.lit("--"))
    amount, sign = pick(none, none, text, text, F.concat(F.lit("-"), text), F.lit("0")), pick(none, none, F.lit("DR"), F.lit(" Cr "), none, none)
    return v.transactions(spark, sf_dir).select("id", s.row_direction_amount(debit, credit, amount, sign).alias("r")).select("id", "r.direction", "r.amount_paise")


@query("mask_digits", sql("SELECT id, CASE id % 3 WHEN 0 THEN '1234' WHEN 1 THEN '9876543210' END AS digits FROM statement_rows"))
def mask_digits(spark, sf_dir):
    return v.statement_rows(spark, sf_dir).select("id", s.mask_digits(F.coalesce("account_mask", F.lit("none"))).alias("digits"))


STMT_KEY = "CASE WHEN reference IS NOT NULL THEN 'stmt|table|' || reference ELSE 'stmt|table|' || occurred_at_ms || '|' || amount_paise || '|' || coalesce(nullif(regexp_replace(lower(merchant), '[^a-z0-9]', '', 'g'), ''), 'x') END"


@query("statement_key", sql(f"SELECT id, {STMT_KEY} AS dedup_key FROM statement_rows"))
def statement_key(spark, sf_dir):
    return v.statement_rows(spark, sf_dir).select("id", s.statement_key("table", F.col("reference"), F.col("occurred_at_ms"), F.col("amount_paise"), F.col("merchant")).alias("dedup_key"))


# --- whole files: an order is a row of its customer group's statement, in one of three layouts


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, row_idx, cells): two title rows, a header, then the file's orders by key; every ninth is a note without an amount."""
    orders = v.transactions(spark, sf_dir).select((F.col("user_id")).alias("f"), "id", "amount_paise", "direction", day_of(F.col("occurred_at_ms")).alias("d"))
    text = F.concat_ws(".", grouped(F.expr("amount_paise div 100")), F.lpad((F.col("amount_paise") % 100).cast("string"), 2, "0"))
    text = F.when(F.col("id") % 9 == 0, "").otherwise(text)
    note, date, out = F.concat(F.lit("UPI/SHOP "), F.col("id") % 50, F.lit("/"), 300000000000 + F.col("id"), F.lit("/x")), F.date_format("d", "dd/MM/yyyy"), F.col("direction") == "debit"
    layouts = [
        F.array(date, note, F.lit(""), F.when(out, text).otherwise(""), F.when(out, "").otherwise(text)), F.array(date, F.when(out, "DR").otherwise("CR"), text, note),
        F.array(F.date_format("d", "dd-MMM-yyyy"), note, F.when(F.col("id") % 9 == 0, "").otherwise(F.concat(F.when(out, "-").otherwise(""), text))),
    ]
    body = orders.select("f", "id", F.when(F.col("f") % 3 == 0, layouts[0]).when(F.col("f") % 3 == 1, layouts[1]).when(F.col("f") % 3 == 2, layouts[2]).alias("cells"))
    heads = [["Date", "Narration", "Chq./Ref.No.", "Withdrawal Amt.", "Deposit Amt."], ["Tran Date", "DR / CR", "Amount (INR)", "Particulars"], ["Txn Date", "Description", "Amount"]]
    title = F.array(F.lit("Statement of account"))
    number = F.array(F.lit("Account No"), F.concat(F.lit("50100"), F.lpad(F.col("f").cast("string"), 8, "0")))
    top = orders.select("f").distinct()
    picked = F.get(F.array(*[F.array(*map(F.lit, h)) for h in heads]), (F.col("f") % 3).cast("int"))
    rows = [top.select("f", F.lit(-3 + i).cast("long").alias("id"), c.alias("cells")) for i, c in enumerate((title, number, picked))]
    out_rows = body
    for r in rows:
        out_rows = out_rows.unionByName(r)
    return out_rows


def statement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, content) with one of four delimiters; cells that hold it are quoted. Every fiftieth file is a zip, every fifty-first an OLE2 file in name only."""
    mark = v.one_of(F.col("f") % 4, [",", ";", "\t", "|"])
    cell = lambda c: F.when(c.contains(",") | c.contains("|") | c.contains(";"), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    lines = statement_lines(spark, sf_dir).withColumn("line", F.call_function("array_join", F.transform("cells", cell), mark))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\r\n")
    return lines.groupBy("f").agg(whole.alias("text")).select(F.col("f").cast("string").alias("file_id"), F.col("text").cast("binary").alias("content"), F.col("f").alias("user_id"))


@query(
    "sniff_format",
    sql("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id, CASE user_id % 5 WHEN 1 THEN 'xlsx' WHEN 2 THEN 'xls' WHEN 3 THEN 'unsupported' ELSE 'delimited' END AS format FROM transactions"),
)
def sniff_format(spark, sf_dir):
    kind = F.col("file_id").cast("int") % 5
    magic = F.when(kind == 1, F.unhex(F.lit("504B0304"))).when(kind == 2, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(kind == 3, F.unhex(F.lit("00"))).otherwise(F.lit("").cast("binary"))
    return files.sniff_format(statement_files(spark, sf_dir).withColumn("content", F.concat(magic, F.col("content"))))


ORDERED = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) + 2 AS row_idx, strftime(o, '%d/%m/%Y') AS dmy FROM (SELECT *, make_timestamp(occurred_at_ms * 1000) AS o FROM transactions))"


@query(
    "read_delimited",
    sql(f"""SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(row_idx AS INTEGER) AS row_idx, CASE user_id % 3 WHEN 0 THEN dmy WHEN 1 THEN dmy ELSE strftime(o, '%d-%b-%Y') END AS first_cell,
  CAST(CASE WHEN id % 9 = 0 THEN CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 2 END ELSE CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 3 END END AS BIGINT) AS n_cells FROM {ORDERED}"""),
)
def read_delimited(spark, sf_dir):
    cells = files.read_delimited(statement_files(spark, sf_dir)).filter("row_idx > 2")
    return cells.groupBy("file_id", "row_idx").agg(F.min_by("cell", "col_idx").alias("first_cell"), F.count("*").alias("n_cells"))


@query(
    "read_delimited_files",
    sql(f"""SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(row_idx AS INTEGER) AS row_idx, CASE user_id % 3 WHEN 0 THEN dmy WHEN 1 THEN dmy ELSE strftime(o, '%d-%b-%Y') END AS first_cell,
  CAST(CASE WHEN id % 9 = 0 THEN CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 2 END ELSE CASE user_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 3 END END AS BIGINT) AS n_cells FROM {ORDERED}"""),
)
def read_delimited_files(spark, sf_dir):
    """The same statements in common files in the shared folder, read in splits."""
    path = shared_path(spark, "statements")
    large_files.pack_files(statement_files(spark, sf_dir).select("file_id", F.decode("content", "UTF-8").alias("text")), path)
    cells = large_files.read_delimited_files(spark, path, packed=True).filter("row_idx > 2")
    return cells.groupBy("file_id", "row_idx").agg(F.min_by("cell", "col_idx").alias("first_cell"), F.count("*").alias("n_cells"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.read_delimited(statement_files(spark, sf_dir))


@query(
    "detect_header",
    sql("""SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id, 2 AS header_row, 0 AS date, CASE user_id % 3 WHEN 1 THEN 3 ELSE 1 END AS description, CASE user_id % 3 WHEN 0 THEN 3 END AS debit,
  CASE user_id % 3 WHEN 0 THEN 4 END AS credit, CASE user_id % 3 WHEN 0 THEN NULL ELSE 2 END AS amount, CASE user_id % 3 WHEN 1 THEN 1 END AS indicator, CASE user_id % 3 WHEN 0 THEN 2 END AS reference FROM transactions"""),
)
def detect_header(spark, sf_dir):
    return st.detect_header(cells(spark, sf_dir)).drop("balance")


@query("account_hint", sql("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id, lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS account_mask FROM transactions"))
def account_hint(spark, sf_dir):
    grid = cells(spark, sf_dir)
    return st.account_hint(grid, st.detect_header(grid))


@query(
    "parse_table_statement",
    sql(f"""SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(row_idx AS INTEGER) AS row_idx, amount_paise, direction, 'Shop ' || (id % 50) AS merchant,
  occurred_at_ms // 86400000 * 86400000 + 43200000 AS occurred_at_ms, lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') AS account_mask, CAST(300000000000 + id AS VARCHAR) AS reference FROM {ORDERED} WHERE id % 9 <> 0"""),
)
def parse_table_statement(spark, sf_dir):
    return st.parse_table_statement(cells(spark, sf_dir)).drop("has_exact_time", "raw_line")


@query("skipped_rows", sql("SELECT CAST(user_id AS VARCHAR) AS file_id, CAST(sum(CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM transactions GROUP BY 1"))
def skipped_rows(spark, sf_dir):
    return st.skipped_rows(cells(spark, sf_dir))


def wallet_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, text): each statement row as one of three layouts, by file."""
    key, amount = F.col("id"), F.concat(F.lit("₹"), F.regexp_replace(F.format_number(F.col("amount_paise") / 100, 2), r"\.00$", ""))
    day = day_of(F.col("occurred_at_ms"))
    date, time = F.date_format(day, "MMM d, yyyy"), F.concat(F.lpad((key % 12 + 1).cast("string"), 2, "0"), F.lit(":"), F.lpad((key % 60).cast("string"), 2, "0"), F.when(key % 2 == 0, " am").otherwise(" pm"))
    tail = [F.concat(F.lit("UTR No. "), 500000000000 + key), F.lit("Paid by XX4321")]
    txn = F.concat(F.lit("Transaction ID T"), key)
    to = F.concat(F.lit("Paid to SHOP "), key % 9)
    layouts = [
        F.array(date, time, F.concat(F.lit("DEBIT "), amount, F.lit("\t"), to), txn, *tail), F.array(date, time, F.lit("DEBIT"), amount, to, txn, *tail),
        F.array(F.concat(date, F.lit(" "), to, F.lit(" DEBIT "), amount), F.concat(time, F.lit(" "), txn), tail[1]),
    ]
    lines = v.statement_rows(spark, sf_dir).select(F.col("user_id").alias("f"), "id", F.array_join(F.get(F.array(*layouts), (F.col("user_id") % 3).cast("int")), "\n").alias("lines"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "lines"))), lambda x: x["lines"]), "\n")
    head = F.lit("Transaction Statement for 98xxxx\nDate Transaction Details UTR No. Amount\n")
    return lines.groupBy("f").agg(F.concat(head, whole).alias("text")).select(F.col("f").cast("string").alias("file_id"), "text")


@query("detect_wallet_statement", sql("SELECT DISTINCT CAST(user_id AS VARCHAR) AS file_id, user_id % 2 = 0 AS wallet FROM statement_rows"))
def detect_wallet_statement(spark, sf_dir):
    half = F.when(F.col("file_id").cast("int") % 2 == 0, F.col("text")).otherwise(F.regexp_replace("text", "UTR", "Ref"))
    return wallet_texts(spark, sf_dir).select("file_id", st.detect_wallet_statement(half).alias("wallet"))


@query(
    "parse_wallet_statement",
    sql("""SELECT CAST(user_id AS VARCHAR) AS file_id, amount_paise, 'debit' AS direction, 'Shop ' || (id % 9) AS merchant, TRUE AS has_exact_time, 'XX4321' AS account_mask,
  occurred_at_ms - 43200000 + (((id % 12 + 1) % 12 + CASE WHEN id % 2 = 1 THEN 12 ELSE 0 END) * 60 + id % 60) * 60000 AS occurred_at_ms,
  CASE WHEN user_id % 3 = 2 THEN 'T' || id ELSE CAST(500000000000 + id AS VARCHAR) END AS reference FROM statement_rows"""),
)
def parse_wallet_statement(spark, sf_dir):
    return st.parse_wallet_statement(wallet_texts(spark, sf_dir)).drop("row_idx", "raw_line")
