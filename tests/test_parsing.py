"""Tables, lines, sections and boxes: small statements with known rows."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import lines, metadata, routing, tables
from ledgerloom.operators.boxes import boxes_to_pages

YEAR = 2024


def as_tables(spark, *all_tables):
    rows = [("s", t, i, cells) for t, table in enumerate(all_tables) for i, cells in enumerate(table, 1)]
    return spark.createDataFrame(rows, "statement_id string, table_no long, row_no long, cells array<string>")


def parsed(df):
    order = [c for c in ("table_no", "row_no", "line_no") if c in df.columns]
    return [
        (str(r.txn_date), r.description, float(r.debit), float(r.credit), float(r.balance), r.type)
        for r in df.orderBy(*order).collect()
    ]


SINGLE_AMOUNT = [
    ["Booking Date", "Activity", "Amount", "D/C", "Bal"],
    ["17/11/2023", "Pottery evening class", "1,275.50", "DR", "8,724.50"],
    ["19/11/2023", "Kiln hire, two days", "310.00", "DR", "8,414.50"],
    ["21/11/2023", "Glaze returned", "96.25", "CR", "8,510.75"],
    ["30/11/2023", "Raffle at the fair", "44.00", "CR", "8,554.75"],
]
WRAPPED = [
    ["Entry Date", "Particulars of Entry", "Instrument", "Paid Out", "Paid In", "Balance"],
    ["03/02/2023", "F ERRY TO THE ISLANDS", "I-9", "86.40", "", "1,913.60"],
    ["07/02/2023", "TRANSFER FROM AUNT ROSA", "I-10", "", "250.00", "2,163.60"],
    ["", "FOR THE GARDEN SHED", "", "", "", ""],
    ["", "AND ITS ROOF", "", "", "", ""],
    ["", "Page Total", "", "", "250.00", ""],
    ["Entry Date", "Particulars of Entry", "Instrument", "Paid Out", "Paid In", "Balance"],
    ["09/02/2023", "only a remark", "", "", "", ""],
]
ONE_WAY = [
    ["All deposits of the month", "", ""],
    ["", "", ""],
    ["Date", "Description", "Amount"],
    ["01/02/2024", "till", "10.00"],
    ["02/02/2024", "till again", "20.00"],
]
MOVEMENT = [
    ["Date", "Narration", "Amount", "Balance"],
    ["01/02/2024", "salary for may", "100.00", "100.00"],
    ["02/02/2024", "shop", "30.00", "70.00"],
    ["03/02/2024", "shop", "30.00", "100.00"],
]


def test_table_shapes(spark):
    df = as_tables(spark, SINGLE_AMOUNT, WRAPPED, ONE_WAY, MOVEMENT, [["a", "b"], ["1", "2"]])
    got = parsed(tables.parse_tables(df, default_year=YEAR))
    assert got == [
        ("2023-11-17", "Pottery evening class", 1275.5, 0, 8724.5, "DEBIT"),
        ("2023-11-19", "Kiln hire, two days", 310, 0, 8414.5, "DEBIT"),
        ("2023-11-21", "Glaze returned", 0, 96.25, 8510.75, "CREDIT"),
        ("2023-11-30", "Raffle at the fair", 0, 44, 8554.75, "CREDIT"),
        ("2023-02-03", "FERRY TO THE ISLANDS", 86.4, 0, 1913.6, "DEBIT"),
        ("2023-02-07", "TRANSFER FROM AUNT ROSA FOR THE GARDEN SHED AND ITS ROOF", 0, 250, 2163.6, "CREDIT"),
        ("2024-02-01", "till", 0, 10, 0, "CREDIT"),
        ("2024-02-02", "till again", 0, 20, 0, "CREDIT"),
        ("2024-02-01", "salary for may", 0, 100, 100, "CREDIT"),
        ("2024-02-02", "shop", 30, 0, 70, "DEBIT"),
        ("2024-02-03", "shop", 0, 30, 100, "CREDIT"),
    ]


def test_long_table_in_small_blocks(spark):
    rnd = random.Random(3)
    body, balance = [["Date", "Narration", "Amount", "Balance"]], 10_000
    for i in range(120):
        step = rnd.choice([-1, 1]) * rnd.randrange(1, 50)
        balance += step
        body.append([f"{i % 28 + 1:02d}/03/2024", f"item {chr(97 + i % 26)}", f"{abs(step)}.00", f"{balance}.00"])
        body += [["", f"note {chr(97 + j)}", "", ""] for j in range(rnd.choice([0, 0, 1, 9]))]
    df = as_tables(spark, body)
    whole = parsed(tables.parse_tables(df, default_year=YEAR))
    cut = parsed(tables.parse_tables(df, default_year=YEAR, block_rows=5))
    assert len(whole) == 120 and whole == cut


def test_cells_to_rows(spark):
    cells = spark.createDataFrame(
        [("s", 0, 1, 1, "b"), ("s", 0, 1, 0, "a"), ("s", 0, 2, 0, None)],
        "statement_id string, table_no long, row_no long, col_no int, cell string",
    )
    got = [r.cells for r in tables.from_cells(cells).orderBy("row_no").collect()]
    assert got == [["a", "b"], [None]]


SECTIONED = """Statement Date: November 9, 2021
Daily Balance
Brought over 10-02 $71.25
Withdrawals and Other Debits
Tran Date    Text    Amount
10-11 Water works 64.10
10-12 Tram pass, zone two 29.00
Total Withdrawals 93.10
Checks Paid This Period
Tran Date    Check Number    Amount    Reference Number
10-23    2207    95.60    0771203
10-27    2208    12.00    0771391
Total Checks Paid 107.60
Deposits and Other Credits
Tran Date    Text    Amount
10-06 Harvest market stall $312.40
tips and small
change box 10-19 $18.75
Total Deposits and Other Credits $331.15"""


def as_pages(spark, *texts, statement="s"):
    rows = [(statement, i, t) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, "statement_id string, page_no long, text string")


def test_sections(spark):
    got = parsed(lines.parse_pages(as_pages(spark, SECTIONED), default_year=YEAR))
    assert got == [
        ("2021-10-11", "Water works", 64.1, 0, 0, "DEBIT"),
        ("2021-10-12", "Tram pass, zone two", 29, 0, 0, "DEBIT"),
        ("2021-10-23", "Check #2207 Ref: 0771203", 95.6, 0, 0, "DEBIT"),
        ("2021-10-27", "Check #2208 Ref: 0771391", 12, 0, 0, "DEBIT"),
        ("2021-10-06", "Harvest market stall", 0, 312.4, 0, "CREDIT"),
        ("2021-10-19", "tips and small change box", 0, 18.75, 0, "CREDIT"),
    ]


def test_sections_go_on_over_pages_and_blocks(spark):
    pages = SECTIONED.split("\n")
    whole = parsed(lines.parse_pages(as_pages(spark, SECTIONED), default_year=YEAR))
    cut = parsed(lines.parse_pages(as_pages(spark, *pages), default_year=YEAR, pages_per_block=2))
    assert cut == whole


# Effect of a heading on the section before it, for headings that depend on it.
HEADINGS = {
    "account summary": lambda s: ("SUMMARY", True),
    "other credits": lambda s: ("CREDIT", True),
    "deposit box": lambda s: ("CREDIT", s != "CREDIT"),
    "withdrawals and debits": lambda s: ("DEBIT", True),
    "debit box": lambda s: ("DEBIT", s != "DEBIT"),
    "deposit or debit": lambda s: ("DEBIT" if s == "CREDIT" else "CREDIT", True),
    "deposit or checks paid": lambda s: ("CHECKS" if s == "CREDIT" else "CREDIT", True),
    "debit or checks paid": lambda s: ("CHECKS" if s == "DEBIT" else "DEBIT", True),
    "checks paid": lambda s: ("CHECKS", True),
    "plain text": lambda s: (s, False),
}


def test_section_states_against_brute_force(spark):
    rnd = random.Random(11)
    words = list(HEADINGS)
    texts = [rnd.choice(words) for _ in range(400)]
    rows = [("s", 0, 400, i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "statement_id string, block long, last_page long, line_no long, line string")
    df = df.withColumn("block", F.floor(F.col("line_no") / 9)).withColumn(
        "event", lines._section_events(F.col("line"), F.array().cast("array<string>"))
    )
    got = [
        (r.section, r.is_header)
        for r in lines._with_sections(df, True).orderBy("line_no").collect()
    ]
    want, state = [], None
    for t in texts:
        state, is_header = HEADINGS[t](state)
        want.append((state, is_header))
    assert got == want


LEDGER_TEXT = """Statement of Account
01/02/2024 Opening salary 100.00 1,100.00
02/02/2024 Tea shop 45.00 1,055.00
 near the gate
03-Feb-2024 Books 20.00 0.00 1,035.00
04/02/2024 Balance line 1,035.00
Total of page 9"""


def test_ledger_lines(spark):
    got = parsed(lines.parse_pages(as_pages(spark, LEDGER_TEXT), default_year=YEAR))
    assert got == [
        # an amount is taken out wherever its digits stand, so "1," is left of the balance
        ("2024-02-01", "Opening salary 1,", 0, 100, 1100, "CREDIT"),
        ("2024-02-02", "Tea shop near the gate", 45, 0, 1055, "DEBIT"),
        ("2024-02-03", "Books", 20, 0, 1035, "DEBIT"),
        ("2024-02-04", "Balance line", 0, 0, 1035, "DEBIT"),
    ]


def test_boxes(spark):
    boxes = [
        ("s", 1, "late", 90.0, 101.0, 12.0, "0.9"), ("s", 1, "first", 10.0, 100.0, 12.0, "0.8"),
        ("s", 1, "faint", 50.0, 100.0, 12.0, "0.1"), ("s", 1, "below", 10.0, 130.0, 12.0, "n/a"),
        ("s", 1, "tall", 60.0, 141.0, 40.0, "1"), ("s", 2, "alone", 0.0, 5.0, 2.0, None),
    ]
    df = spark.createDataFrame(boxes, "statement_id string, page_no long, text string, x double, y double, h double, score string")
    got = {r.page_no: r.text for r in boxes_to_pages(df).collect()}
    assert got == {1: "first    late\nbelow    tall", 2: "alone"}


ISSUERS = {
    "MAPLE GROVE BANK LIMITED since 1911": ("Maple Grove Bank", 0.92),
    "your account at STATE BANK OF INDIA, Lake Gate IFSC: SBIN0004242": ("State Bank of India (SBI)", 0.95),
    "Entries of the quarter IFSC: FDRL0001188": ("Federal Bank", 0.95),
    "IFSC: ZQXW0007777": ("ZQXW Bank", 0.85),
    "ORCHARD CO-OPERATIVE BANK LIMITED\nMill Lane": ("Orchard Co-operative Bank", 0.92),
    "BASALT BANK PLC\n88 Pier Street": ("Basalt Bank", 0.92),
    "HDFCBANK": ("HDFC Bank", 0.90),
    "Pine Savings Member FDIC": ("Pine Savings", 0.95),
    "nothing here": ("Universal Bank / Financial Institution", 0.5),
}


def test_issuers(spark):
    rows = [(t, 1, t) for t in ISSUERS]
    df = spark.createDataFrame(rows, "statement_id string, page_no long, text string")
    got = {r.statement_id: (r.bank_name, r.bank_confidence) for r in metadata.detect_issuers(df).collect()}
    assert got == ISSUERS


def test_match_over_a_page_border(spark):
    df = as_pages(spark, "Customer Name: ANN LEE\nIFSC: HDFC0001234\nStatement Date:", "June 5, 2017\nAccount Number: 12345678")
    got = metadata.account_details(df, default_year=YEAR).first()
    assert (got.statement_year, got.account_number, got.account_holder, got.ifsc_code) == (
        2017, "12345678", "ANN LEE", "HDFC0001234",
    )


def test_blank_lines_and_many_lines_at_a_page_border(spark):
    blank = as_pages(spark, "First page\nAccount Number:" + "\n \n" * 6, "\n\n \t\n\n12345678\nOpening\nBalance\n:\n", "\n" * 9 + "Rs. 1,250.50\nend")
    got = metadata.account_details(blank, default_year=YEAR).first()
    assert (got.account_number, float(got.opening_balance)) == ("12345678", 1250.5)
    apart = as_pages(spark, "x\nBeginning\nBalance\non\nJune", "5\n,\n\n2017\nend")
    assert metadata.statement_years(apart).first().statement_year == 2017


def test_head_text_over_many_short_pages(spark):
    texts = [f"p{i}" for i in range(30)]
    got = metadata.head_text(as_pages(spark, *texts), 50).first().head
    assert got == "\n".join(texts)[:50]


def test_routes(spark):
    docs = spark.createDataFrame(
        [("a", True, False), ("b", True, True), ("c", True, False), ("d", False, False), ("e", True, False)],
        "statement_id string, is_text_based boolean, text_error boolean",
    )
    text = spark.createDataFrame([("a",)], "statement_id string")
    image = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "statement_id string")
    got = {r.statement_id: r.file_type for r in routing.choose_routes(docs, text, image).collect()}
    scanned = "Image-based PDF (OCR)"
    assert got == {
        "a": "Text-based PDF", "b": f"{scanned} [Fallback]", "c": f"{scanned} [Adaptive]", "d": scanned,
        "e": "Text-based PDF",
    }


def test_long_numbers_do_not_stop_the_job(spark):
    huge = "98765432109876543210.00"
    table = [
        ["Ledger extract", "", "", "", ""],
        ["01/02/2024", "payment", huge, "0.00", "40.00"],
        ["02/02/2024", "cash", "5.00", "0.00", "35.00"],
        ["03/02/2024", "cash", "5.00", "0.00", "30.00"],
    ]
    got = parsed(tables.parse_tables(as_tables(spark, table), default_year=YEAR))
    assert [r[4] for r in got] == [40, 35, 30]
    text = f"01/02/2024 paid {huge} 12.00 40.00\n02/02/2024 cash 5.00 35.00"
    got = parsed(lines.parse_pages(as_pages(spark, text), default_year=YEAR))
    assert [r[4] for r in got] == [40, 35]
    sectioned = f"Deposits and Other Credits\n02-03 parcel {huge}\n02-04 stall 7.50\nTotal Deposits and Other Credits 7.50"
    got = parsed(lines.parse_pages(as_pages(spark, sectioned), default_year=YEAR))
    assert [r[3] for r in got][-1] == 7.5


def test_sample_holds_whole_pages(spark):
    pages = as_pages(spark, "a" * 5000, "b" * 10).unionByName(
        as_pages(spark, *[f" p{i} " for i in range(1, 40)], statement="t")
    )
    got = {r.statement_id: r.sample_text for r in routing.document_types(pages).collect()}
    assert got["s"] == "a" * 5000
    assert got["t"] == "\n".join(f" p{i} " for i in range(1, 40)).strip()


def test_image_documents_without_boxes_keep_their_text(spark):
    docs = spark.createDataFrame(
        [("a", False, False), ("b", False, False), ("c", False, False), ("d", True, False)],
        "statement_id string, is_text_based boolean, text_error boolean",
    )
    text = spark.createDataFrame([("a", 1), ("b", 1), ("d", 1)], "statement_id string, n int")
    image = spark.createDataFrame([("b", 2), ("d", 2)], "statement_id string, n int")
    routes = routing.choose_routes(docs, text, image)
    assert {r.statement_id: r.route for r in routes.collect()} == {"a": "text", "b": "image", "c": "image", "d": "text"}
    kept = {(r.statement_id, r.n) for r in routing.routed_rows(routes, text, image).collect()}
    assert kept == {("a", 1), ("b", 2), ("d", 1)}


def test_issuer_of_statements_that_are_only_scanned(spark):
    first = metadata.detect_issuers(as_pages(spark, "plain text"))
    rebuilt = metadata.detect_issuers(as_pages(spark, "HDFCBANK", statement="boxes").unionByName(as_pages(spark, "HDFCBANK")))
    got = {r.statement_id: r.bank_name for r in metadata.redetect(first, rebuilt).collect()}
    assert got == {"s": "HDFC Bank", "boxes": "HDFC Bank"}


def test_years_over_table_rows(spark):
    def years(*all_tables, block_rows=50_000):
        facts = tables.table_facts(as_tables(spark, *all_tables), default_year=YEAR, block_rows=block_rows)
        return [r.statement_year for r in facts.orderBy("table_no").collect()]

    row = lambda *cells: [*cells, "", "", ""][:3]
    end = [row("12 Mar", "x", "1.00")] * 3
    cases = [
        [row("Date of", "Statement"), row(), row(":", "May"), row("5,"), row("2011", "2030"), *end],
        [row("Period of"), *end, row("x 1 y"), row("ends 2012", "2013"), *end],
        [row("Period of"), row("so\nit is 2013"), row("2014 2014"), *end],  # the line ends before a year
        [row("Period 2015"), row("Period"), row("2016"), *end],
        [row("Period"), row("2051"), row("Period 2016"), row("2017"), *end],  # no accepted year: patterns go on
        [row("May"), row("one 5, 2018 a b c d e f"), row("2019", "2019"), *end],  # words stand between
        [row("May"), row("5,", "2020"), row("May 6, 2021"), *end],
        [row(None, "Period"), row(None), [None, None, "1\n2022"], *end],
        [*end, *end],
    ]
    want = [2011, 2012, 2014, 2015, 2016, 2019, 2020, 2022, None]
    assert years(*cases) == want
    assert years(*cases, block_rows=2) == want
