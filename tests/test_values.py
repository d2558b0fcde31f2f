"""Amounts, dates, header roles, labels: single values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import clean_amount
from ledgerloom.functions.dates import modal_year, parse_date, stated_year, year_tokens
from ledgerloom.functions.headers import header_roles
from ledgerloom.functions.labels import channel, merchant, rule_labels
from ledgerloom.functions.text import normalize_narration, repair_wraps, title_case

AMOUNTS = {
    "1,234.50": 1234.5, "1,25,000.00": 125000, "₹ 99.00": 99, "(500.00)": -500, "($20.10)": -20.1,
    "1.234,56": 1234.56, "12,34": 12.34, "75,5": 755, "500 Dr": -500, "500 DR": -500, "500 dr": 500,
    "700 Cr": 700, "-": 0, "--": 0, "NA": 0, "nil": 0, "": 0, "0": 0, "Rs.500.00": 0, "Rs 500": 500,
    "-12.5": -12.5, "12.5-": -12.5, "abc": 0, "1.2.3": 0, " 45.10 ": 45.1, None: 0, "10,00,000": 1000000,
}

DATES = {
    # text: (iso, raw)
    "05/09/2024": ("2024-09-05", "05/09/2024"),
    "12/25/2024": ("2024-12-25", "12/25/2024"),
    "5.9.24": ("2024-09-05", "5.9.24"),
    "01-Sep-2024": ("2024-09-01", "01-Sep-2024"),
    "1 september 24": ("2024-09-01", "1 september 24"),
    "September 1, 2024": ("2024-09-01", "September 1, 2024"),
    "2024-9-1": ("2024-09-01", "2024-9-1"),
    "2024/09/01": ("2024-09-01", "2024/09/01"),
    "paid 03/04/2021 late": ("2021-04-03", "03/04/2021"),
    "05/09/1924": ("2024-09-05", "05/09/1924"),
    "05-15": ("2001-05-15", "05-15"),
    "15-05": ("2001-05-15", "15-05"),
    "May 5, 24": ("2001-05-05", "May 5"),
    "June05": ("2001-06-05", "June05"),
    "5 June": ("2001-06-05", "5 June"),
    "10.25": ("2001-10-25", "10.25"),
    "05/09/1960": ("2001-05-09", "05/09"),
    "31/02/2024": (None, None),
    "45-77": (None, None),
    "05-September-24": (None, None),
    "no date": (None, None),
    "": (None, None),
    None: (None, None),
}


def test_amounts(spark):
    rows = spark.createDataFrame([(k,) for k in AMOUNTS], "t string")
    got = {r.t: float(r.v) for r in rows.select("t", clean_amount("t").alias("v")).collect()}
    assert got == {k: pytest.approx(v) for k, v in AMOUNTS.items()}


def test_rs_prefix_is_an_option(spark):
    rows = spark.createDataFrame([("Rs.500.00",), ("rs. 1,250.00 Dr",)], "t string")
    got = [float(r.v) for r in rows.select(clean_amount("t", read_rs_prefix=True).alias("v")).collect()]
    assert got == [500.0, -1250.0]


def test_dates(spark):
    rows = spark.createDataFrame([(k,) for k in DATES], "t string")
    parsed = rows.select("t", parse_date("t", "2001", default_year=1999).alias("p"))
    got = {r.t: (r.d, r.raw) for r in parsed.select("t", F.col("p.date").cast("string").alias("d"), "p.raw").collect()}
    assert got == DATES


def test_default_year_only_without_statement_year(spark):
    rows = spark.createDataFrame([("05-15", None), ("05-15", 1850), ("05-15", 2010)], "t string, y int")
    got = [str(r.d) for r in rows.select(parse_date("t", "y", default_year=1999)["date"].alias("d")).collect()]
    assert got == ["1999-05-15", "1999-05-15", "2010-05-15"]


def test_years(spark):
    text = "Statement Date: June 5, 2019 and Period from there to 2021"
    rows = spark.createDataFrame([(text,)], "t string")
    got = rows.select(stated_year(F.col("t"), 0).alias("a"), stated_year(F.col("t"), 2).alias("b")).first()
    assert (got.a, got.b) == (2019, 2021)
    rows = spark.createDataFrame([("2003 1999 2003 1999 2050 1888",)], "t string")
    assert rows.select(modal_year(year_tokens(F.col("t"))).alias("y")).first().y == 2003


HEADERS = [
    (["Date", "Value Date", "Narration", "Debit", "Credit", "Balance"], dict(date=0, desc=2, debit=3, credit=4, balance=5)),
    (["Post Date", "Memo", "Amount", "Dr/Cr", "Bal"], dict(date=0, desc=1, amount=2, type=3, balance=4)),
    (["Txn Dt", "Details", "Chq No", "Paid Out", "Paid In", "Closing"], dict(date=0, desc=1, ref=2, debit=3, credit=4, balance=5)),
    (["Date", "Txn Type", "Description", "Amount", "Debit"], dict(date=0, type=1, desc=2, amount=3, debit=4)),
    (["Debit", "Amount", "Date", None, ""], dict(debit=0, date=2)),
]


@pytest.mark.parametrize("cells,roles", HEADERS)
def test_header_roles(spark, cells, roles):
    df = spark.createDataFrame([(cells,)], "cells array<string>")
    got = df.select(header_roles(F.col("cells")).alias("r")).first().r.asDict()
    assert {k: v for k, v in got.items() if v >= 0} == roles


def test_text_helpers(spark):
    df = spark.createDataFrame([("K IRANA  corner Z EPTO a bc", "o'neil-1MG AIR", "Ref 123456 A/B_12 x9")], "a string, b string, c string")
    got = df.select(repair_wraps(F.col("a")).alias("a"), title_case(F.col("b")).alias("b"), normalize_narration(F.col("c")).alias("c")).first()
    assert got.a == "KIRANA corner ZEPTO a bc"
    assert got.b == "O'Neil-1Mg Air"
    assert got.c == "ref a b x9"


CHANNELS = {
    "upi/1/x": "UPI", "NEFT UPI": "UPI", "cash at NFS": "ATM Cash", "Debit Card buy": "POS / Card",
    "position": "Internal / NetBanking", "INWARD CLG 7": "Cheque", "int.pd: may": "Interest",
}
MERCHANTS = {
    "POS 12 AIR INDIA desk": "Air India", "UPI/88/tea_stall-7/DR": "Tea Stall 7", "PAY TO Blue Door": "Blue Door",
    "UPI/12/34/Ref TO Big Shop": "Big Shop", "plain text": None,
}


def test_channels_and_merchants(spark):
    df = spark.createDataFrame([(t,) for t in CHANNELS], "d string")
    assert {r.d: r.c for r in df.select("d", channel(F.col("d")).alias("c")).collect()} == CHANNELS
    df = spark.createDataFrame([(t,) for t in MERCHANTS], "d string")
    assert {r.d: r.m for r in df.select("d", merchant(F.col("d")).alias("m")).collect()} == MERCHANTS


LABELS = [
    # narration, debit, credit, type, category, sub category, confidence
    ("ACH CR monthly PAYROLL", 0, 10, "CREDIT", "Salary & Income", None, 0.95),
    ("salary advance recovery", 10, 0, "DEBIT", "Miscellaneous / Others", None, 0.5),
    ("office expense", 10, 0, "DEBIT", "Investments & Trading", None, 0.95),  # "nse" inside a word
    ("nfs*cash 12", 10, 0, "DEBIT", "Cash & ATM Withdrawal", None, 0.95),
    ("nfscash", 10, 0, "DEBIT", "Miscellaneous / Others", None, 0.5),
    ("imps to a friend", 10, 0, "DEBIT", "Transfer (P2P / Self)", None, 0.75),
    ("rtgs 12", 10, 0, "DEBIT", "Miscellaneous / Others", None, 0.5),
    ("unknown", 0, 10, "CREDIT", "Salary & Income", "Other Deposit", 0.6),
    ("home loan refund", 0, 10, "CREDIT", "Salary & Income", "Other Deposit", 0.6),
    ("h&m jacket", 10, 0, "DEBIT", "Shopping & E-Commerce", None, 0.95),
    ("tds deducted", 10, 0, "DEBIT", "Bank Charges & Taxes", None, 0.95),
    # amount says credit, type says debit: both directions hold
    ("emi reversed", 0, 10, "DEBIT", "Loan EMI & Credit Card", None, 0.95),
]


def test_rule_labels(spark):
    df = spark.createDataFrame([r[:4] for r in LABELS], "description string, debit int, credit int, type string")
    got = [tuple(r) for r in rule_labels(df).collect()]
    assert got == LABELS
