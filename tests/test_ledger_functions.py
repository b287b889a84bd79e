"""Golden values of the column functions, each evaluated over one frame."""

from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import matching, messages, periods, statements
from ledgerloom.functions.text import day_of, ms_of, squeezed
from ledgerloom.operators import rules
from ledgerloom.operators import splits as sp
from ledgerloom.operators import statements as st
from ledgerloom.sources import files


def ms(y, m, d, h=12, minute=0):
    return int((datetime(y, m, d, h, minute) - datetime(1970, 1, 1)).total_seconds() * 1000)


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x")).alias("y")).collect()]


def parse(spark, bodies, posted=ms(2025, 8, 12, 15)):
    rows = spark.createDataFrame([(i, 1, "sms", "HDFCBK", b, posted) for i, b in enumerate(bodies)], "id long, user_id long, source string, sender string, body string, posted_at_ms long")
    return {r["id"]: r for r in messages.parse_captures(rows).collect()}


def test_parse_messages(spark):
    got = parse(
        spark,
        [
            "Rs.450.00 spent on HDFC Bank Card x1234 at SWIGGY on 12-08-25. Not you? Call 18002586161",
            "INR 1,200.00 debited from A/c XX4321 on 12-Aug-25. Info: UPI/523401/ZOMATO. Avl Bal INR 22,300.55",
            "Your A/c XX2211 is credited with INR 85,000.00 on 01-Aug-25 by SALARY CORP.  Avl bal INR 1,00,000",
            "123456 is your OTP for Rs.500 at Amazon, do not share", "Big sale! Get loan offer of Rs 5,00,000 credited today", "Your balance is Rs 500", "paid to nobody", "", "Rs 0.00 debited", "50 rs paid to Ravi",
            "Payment of Rs 10 declined, amount debited will be returned",
        ],
    )
    assert set(got) == {0, 1, 2, 9}
    assert (got[0]["amount_paise"], got[0]["direction"], got[0]["last4"], got[0]["merchant"], got[0]["confidence"]) == (45000, "debit", "1234", "Swiggy", 1.0)
    assert (got[1]["amount_paise"], got[1]["direction"], got[1]["last4"], got[1]["merchant"], got[1]["reference"]) == (120000, "debit", "4321", "Zomato", "523401")
    assert (got[2]["amount_paise"], got[2]["direction"], got[2]["last4"]) == (8500000, "credit", "2211")
    assert got[2]["occurred_at_ms"] == ms(2025, 8, 1) and got[0]["occurred_at_ms"] == ms(2025, 8, 12, 15)
    assert (got[9]["amount_paise"], got[9]["merchant"]) == (5000, "Ravi")


def test_message_dates(spark):
    texts = ["on 40 Jan 25", "on 31-Jul-25", "on 31/06/25", "on 01/01/2020", "on 5 Xyz 25 and 11-08-25", "nothing"]
    want = [ms(2025, 8, 12, 15), ms(2025, 7, 31), ms(2025, 7, 1), ms(2025, 8, 12, 15), ms(2025, 8, 11), ms(2025, 8, 12, 15)]
    assert apply(spark, texts, lambda t: messages.extract_occurred_at(t, F.lit(ms(2025, 8, 12, 15)))) == want


def test_references(spark):
    texts = ["Info: UPI/DR/523401234567/ZOMATO/ICIC", "debited a/c XX1234 to SWIGGY", "Txn ID: AB12CD34", "RRN 123456789012", "Ref No 998877", "UTR: HDFC12345678", "ref 12345", "NEFT-N123456"]
    assert apply(spark, texts, messages.extract_reference) == ["523401234567", None, "AB12CD34", "123456789012", "998877", "HDFC12345678", None, "N123456"]


def test_account_numbers(spark):
    texts = ["Rs.20000 debited from A/c XX1234 and credited to A/c XX5678 XX1234", "card ending 4321", "none 1234"]
    assert apply(spark, texts, messages.extract_all_last4) == [["1234", "5678"], ["4321"], []]
    assert apply(spark, texts, messages.extract_last4) == ["1234", "4321", None]


def test_key_and_labels(spark):
    def plain(s):
        h = 5381
        for c in s:
            h = (h * 33 + ord(c)) % 2**32
        digits = ""
        while h:
            digits, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + digits, h // 36
        return digits

    texts = ["Rs.450 spent ₹", "a", "x" * 300]
    assert apply(spark, texts, messages.text_hash) == [plain(t) for t in texts]
    assert apply(spark, ["  ", None, " Dinner "], lambda t: messages.display_title(t, F.lit(None).cast("string"))) == ["Unknown", "Unknown", "Dinner"]
    assert apply(spark, ["statement:x", "HDFC", None], lambda s: messages.origin_badge(messages.capture_origin(F.lit("sms"), s))) == ["PDF", "SMS", "SMS"]
    assert apply(spark, ["stmt|f|123456", "stmt|f|12", "x|f|123456"], lambda k: messages.payment_reference(F.lit(None).cast("string"), k)) == ["123456", None, None]


@pytest.mark.parametrize("a,b,same", [("261401", "585204261401", True), ("12345", "123456789012", False), ("ab-1234", "AB1234", True), ("123456", "654321", False), (None, "123456", False), ("585204", "585204261401", True)])
def test_references_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(matching.references_match(matching.bare_reference(F.col("a")), matching.bare_reference(F.col("b")))).first()[0] is same


@pytest.mark.parametrize("a,b,same", [("swiggy", "swiggylimited", True), ("dad", "dadar", False), ("dad", "dad", True), (None, "x", False)])
def test_merchants_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(matching.merchants_match(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize(
    "hours,a,b,origin,same",
    [(7, "swiggylimited", "swiggy", "sms", True), (13, "swiggy", "swiggy", "sms", False), (6, "swiggy", "swiggy", "statement", False), (0.05, "swiggy", "swiggy", "statement", True), (0.1, None, "swiggy", "statement", True), (7, None, "swiggy", "sms", False)],
)
def test_is_same_payment(spark, hours, a, b, origin, same):
    df = spark.createDataFrame([(0, int(hours * 3_600_000), a, b, origin)], "t1 long, t2 long, a string, b string, o string")
    one, two = ("t1", "a"), ("t2", "b")
    for (ta, ma), (tb, mb) in ((one, two), (two, one)):
        assert df.select(matching.is_same_payment(F.col(ta), F.col(ma), F.lit("statement"), F.col(tb), F.col(mb), F.col("o"))).first()[0] is same


def test_loose_numbers(spark):
    texts = ["(200.00)", "2,000.00 Dr", "Rs. 1,50,000.00", "1.234,50", "1,234", "1,5", "NA", "", "₹ 40", "+5", "-7.5", "12 345,00", "100 Cr", "(5) Dr", "1.2.3", ".5"]
    assert apply(spark, texts, statements.parse_loose_number) == [-200, -2000, 150000, 1234.5, 1234, 1.5, None, None, 40, 5, -7.5, 12345, 100, None, None, 0.5]


def test_table_dates(spark):
    texts = ["15-Sept-2026", "Aug 15, 2026", "46249", "08/09/2026", "32/08/2026", "2026-08-15", "31/02/2026", "15.08.26 10:00", "15/08/71", "junk", "", None]
    want = [ms(2026, 9, 15), ms(2026, 8, 15), ms(2026, 8, 15), ms(2026, 9, 8), None, ms(2026, 8, 15), None, ms(2026, 8, 15), ms(1971, 8, 15), None, None, None]
    assert apply(spark, texts, statements.parse_table_date) == want


def test_narrations(spark):
    texts = ["ACHCR/MAHINDRA AND MAHINDR/2547275115/111431588901", "UPI/x@ybl/123456789/Corner  Shop", "NEFT|DR|12"]
    assert apply(spark, texts, statements.narration_reference) == ["111431588901", "123456789", None]
    assert apply(spark, texts, statements.narration_merchant) == ["Mahindra And Mahindr", "Corner Shop", None]


@pytest.mark.parametrize("amount,parts,want", [(100000, 3, [33334, 33333, 33333]), (0, 3, []), (1000, 0, []), (7, 10, [1] * 7 + [0] * 3)])
def test_even_shares(spark, amount, parts, want):
    df = spark.createDataFrame([(amount, parts)], "a long, n long")
    assert df.select(sp.even_shares(F.col("a"), F.col("n"))).first()[0] == want


def test_split_with_me_and_toggle(spark):
    df = spark.createDataFrame([(100000, [1, 2])], "a long, p array<long>")
    shares = lambda c: [tuple(x) for x in df.select(c).first()[0]]
    assert shares(sp.split_evenly_with_me(F.col("a"), F.col("p"))) == [(1, 33333), (2, 33333)]
    assert shares(sp.toggle_share(F.col("p"), F.lit(2).cast("long"), F.col("a"))) == [(1, 50000)]
    assert shares(sp.toggle_share(F.col("p"), F.lit(3).cast("long"), F.col("a"))) == [(1, 25000), (2, 25000), (3, 25000)]
    assert df.select(sp.my_share(F.lit(30000), F.lit(50000))).first()[0] == 0


def test_cycles(spark):
    cases = [(date(2026, 8, 20), 7, date(2026, 8, 7)), (date(2026, 8, 3), 7, date(2026, 7, 7)), (date(2026, 2, 15), 31, date(2026, 1, 31)), (date(2024, 3, 15), 30, date(2024, 2, 29)), (date(2026, 2, 28), 31, date(2026, 2, 28))]
    df = spark.createDataFrame(cases, "d date, k int, want date")
    for r in df.select("want", periods.cycle_start(F.col("d"), F.col("k")).alias("got")).collect():
        assert r["got"] == r["want"]
    # cycles tile time: each day's cycle ends where the next begins
    days = spark.range(800).select(F.date_add(F.lit("2023-12-01").cast("date"), F.col("id").cast("int")).alias("d"))
    bad = days.withColumn("s", periods.cycle_start(F.col("d"), 31)).filter(~F.col("d").between(F.col("s"), F.date_sub(periods.cycle_end(F.col("s"), 31), 1)))
    assert bad.count() == 0


def test_period_ranges():
    day = 86_400_000
    now = datetime(2026, 8, 20, 0, 0)
    start, end = periods.period_range("Day", now)
    assert start == ms(2026, 8, 20, 0) and end - start == day
    assert periods.period_range("Week", now) == (ms(2026, 8, 17, 0), ms(2026, 8, 24, 0))
    assert periods.period_range("Month", now, cycle_day=31) == (ms(2026, 7, 31, 0), ms(2026, 8, 31, 0))
    assert periods.period_range("Pick month", now, month=date(2026, 2, 3), cycle_day=31) == (ms(2026, 2, 28, 0), ms(2026, 3, 31, 0))
    assert periods.period_range("Custom", now, date(2026, 5, 2), date(2026, 5, 1)) == (ms(2026, 5, 1, 0), ms(2026, 5, 3, 0))
    assert periods.period_range("Custom", now)[1] == ms(2026, 8, 21, 0) and periods.period_range("All", now) == (None, None)


def test_days_round_trip(spark):
    assert apply(spark, [ms(1969, 12, 31, 23), ms(2026, 8, 20, 1)], lambda t: ms_of(day_of(t)), "long") == [ms(1969, 12, 31, 0), ms(2026, 8, 20, 0)]
    assert apply(spark, ["  a \n b  "], squeezed) == ["a b"]


def test_keywords(spark):
    texts = [("swiggy order", "debit"), ("salary july", "debit"), ("salary july", "credit"), ("neft to x", "debit"), ("swiggy", "credit"), ("zzz", "debit"), ("premium", "debit")]
    df = spark.createDataFrame(texts, "t string, d string")
    lists = {"Food & Dining": ["swiggy"], "Loan & EMI": ["emi"], "Salary": ["salary"], "Transfers": ["neft"]}
    got = [r[0] for r in df.select(rules.keyword_category(F.col("t"), F.col("d"), lists)).collect()]
    assert got == ["Food & Dining", "Other", "Salary", "Transfers", "Other Income", "Other", "Loan & EMI"]
    assert df.select(rules.keyword_category(F.col("t"), F.col("d"), {"Mine": ["zzz"]})).collect()[5][0] == "Mine"


def test_table_dates_of_every_form_are_read_once(spark):
    """Patterns are only taken apart where they fit, and a filter on the result doesn't read dates and amounts again."""
    made = {"03/04/2024": "2024-04-03", "2024-04-03": "2024-04-03", "3-Apr-24": "2024-04-03", "Apr 3, 2024": "2024-04-03", "03 Apr 2024": "2024-04-03", "45385": "2024-04-03", "31/02/2024": None, "3-Foo-2024": None, "": None, "x": None, "03/04/2024 10:30": "2024-04-03"}
    rows = spark.createDataFrame(list(made.items()), "raw string, want string").select("raw", "want", statements.parse_table_date(F.col("raw")).alias("ms"))
    assert [(r["raw"], r["day"]) for r in rows.select("raw", F.date_format(day_of(F.col("ms")), "yyyy-MM-dd").alias("day")).collect()] == list(made.items())
    cells = spark.createDataFrame([("f", i, j, c) for i, row in enumerate([["Date", "Narration", "Amount"], ["03/04/2024", "UPI/SHOP/300000000001/x", "-5.00"], ["note", None, None]]) for j, c in enumerate(row) if c], "file_id string, row_idx int, col_idx int, cell string")
    out = st.parse_table_statement(cells)
    assert [(r["row_idx"], r["amount_paise"], r["direction"]) for r in out.collect()] == [(1, 500, "debit")]
    assert all(st.DATE_WORD in s for s in statements.COLUMN_SYNONYMS["date"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    filters = [x for x in plan.split("\n") if "Filter" in x]
    assert not any("\\d" in x or "make_date" in x for x in filters)


def test_small_files_share_batches():
    """Ten files leave the parser as one batch of cells, not one each."""
    made = pa.RecordBatch.from_pydict({"file_id": [str(i) for i in range(10)], "content": [f'a;b;c\n{i};"x;y";z'.encode() for i in range(10)]})
    out = [b.to_pylist() for b in files._cell_batches(iter([made]))]
    assert [len(b) for b in out] == [60]
    assert [r["cell"] for r in out[0] if r["file_id"] == "7" and r["row_idx"] == 1] == ["7", "x;y", "z"]


def test_only_the_fields_used_are_read(spark):
    """A job that takes no merchant and no reference doesn't look for them, and a pattern is looked for once."""
    rows = spark.createDataFrame([(1, 1, "sms", "HDFCBK", "Rs.5.00 spent on Card XX1234 at Shop Ref 400001", 0)], "id long, user_id long, source string, sender string, body string, posted_at_ms long")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few, every = plan(messages.parse_captures(rows).select("id", "amount_paise", "last4")), plan(messages.parse_captures(rows))
    assert "towards" not in few and "rtgs" not in few and "spent" in few
    assert every.count(r"\brrn") == 1 and every.count("towards") == 1
