"""Statements as they look on paper, rendered from the typed ledger.

The parsers read these and must give the typed ledger back. A page (and so a table) holds
``PAGE_ROWS`` ledger rows. They are written to the shared folder first: a parser reads its
input tables more than once, as it would read tables that an extractor wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .inputs import ledger

PAGE_ROWS = 40
# The row of a page behind which the first layout repeats its header.
HEADER_AGAIN = 3

# How many ways a date is written, by transaction number.
DATE_STYLES = ["dd/MM/yyyy", "dd-MMM-yyyy", "dd/MM/yy", "yyyy-MM-dd", "dd.MM.yyyy", "MMM d, yyyy"]


def page_of(row_no: Column) -> Column:
    return F.floor((row_no - 1) / PAGE_ROWS).cast("long")


def written_date(date: Column, txn_id: Column) -> Column:
    chain = None
    for i, style in enumerate(DATE_STYLES):
        value = F.date_format(date, style)
        hit = txn_id % len(DATE_STYLES) == i
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def written_money(amount: Column, *, zero: str = "") -> Column:
    return F.when(amount == 0, F.lit(zero)).otherwise(F.format_number(amount, 2))


def _row(*cells: Column) -> Column:
    return F.array(*cells)


def _text_row(*cells: str) -> Column:
    return F.array(*[F.lit(c) for c in cells])


# Header rows of the four layouts; the third has no header, the fourth spreads it over two rows.
HEADERS = [
    [["Entry Date", "Narration", "Instrument", "Paid Out", "Paid In", "Balance After Entry"]],
    [["Booking Date", "Activity", "Amount", "D/C", "Bal"]],
    [["Ledger extract", "", "", "", ""]],
    [["Posting", "Entry", "", "Running"], ["Date", "Particulars", "Amount", "Balance"]],
]


def _by_layout(layout: Column, values: list[Column]) -> Column:
    chain = F.when(layout == 0, values[0])
    for i, v in enumerate(values[1:], 1):
        chain = chain.when(layout == i, v)
    return chain


def _pages(rows: DataFrame, head: Column, foot: Column) -> DataFrame:
    """Number the rows of each page; a page has at most PAGE_ROWS ledger rows."""
    pages = rows.groupBy("statement_id", "table_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", "lines"))).alias("body")
    )
    body = F.flatten(F.transform("body", lambda b: b["lines"]))
    return pages.select(
        "statement_id", "table_no", F.posexplode(F.concat(head, body, foot)).alias("at", "cells")
    ).select(
        "statement_id", "table_no", (F.col("at") + 1).cast("long").alias("row_no"), "cells"
    )


def tables(spark: SparkSession, sf_dir: str, layout: Column) -> DataFrame:
    """Tables in one of four layouts; every fifth narration wraps onto a dateless row."""
    t = ledger(spark, sf_dir).withColumn("layout", layout)
    date = written_date(F.col("txn_date"), F.col("txn_id"))
    narration = F.col("description")
    wraps = (F.col("txn_id") % 5 == 0) & narration.contains(" ")
    first = F.when(wraps, F.regexp_replace(narration, r"\s+\S*$", "")).otherwise(narration)
    last = F.regexp_extract(narration, r"(\S*)$", 1)
    debit, credit, balance = F.col("debit"), F.col("credit"), F.col("balance")
    size = F.format_number(debit + credit, 2)
    total = F.format_number(balance, 2)
    blank = F.lit("")
    starts = [
        _row(date, first, F.concat(F.lit("REF"), F.col("txn_id").cast("string")), written_money(debit), written_money(credit), total),
        _row(date, first, size, F.when(credit > 0, F.lit("CR")).otherwise(F.lit("DR")), total),
        _row(date, first, written_money(debit, zero="0.00"), written_money(credit, zero="0.00"), total),
        _row(date, first, size, total),
    ]
    more = [
        _row(blank, last, *([blank] * (len(HEADERS[i][-1]) - 2))) for i in range(4)
    ]
    lines = F.when(
        wraps, F.array(_by_layout(F.col("layout"), starts), _by_layout(F.col("layout"), more))
    ).otherwise(F.array(_by_layout(F.col("layout"), starts)))
    again = (F.col("layout") == 0) & ((F.col("row_no") - 1) % PAGE_ROWS == HEADER_AGAIN - 1)
    lines = F.when(again, F.concat(lines, F.array(_text_row(*HEADERS[0][0])))).otherwise(lines)
    rows = t.select(
        "statement_id", page_of(F.col("row_no")).alias("table_no"), "row_no", lines.alias("lines")
    )
    heads = _by_layout(layout, [F.array(*[_text_row(*r) for r in h]) for h in HEADERS])
    foots = _by_layout(
        layout, [F.array(_text_row("Page Total", *([""] * (len(h[-1]) - 1)))) for h in HEADERS]
    )
    return stage(_pages(rows, heads, foots), "tables")


# Rows above a ledger that say its year over several rows; {} is the year, the others are not it.
YEAR_ROWS = [
    [["Statement", "", ""], ["", "Date: May", ""], ["5,", "{}", ""], ["Period 1991", "", ""]],
    [["Opening of this", "Period", ""], ["", "branch unknown", ""], ["", "", ""], ["until", "{}", "1993"]],
    [["", "Period\n", ""], ["1992 printed", "", ""], ["", "{} and {}", ""], ["", "", ""]],
    [["Ending", "", ""], ["", "Balance on", ""], ["June", "3,", ""], ["", "", "{}"]],
    [["", "", "March"], ["", "", ""], ["2,", "{}", ""], ["in 1994", "1994", ""]],
    [["Period from May", "{}", ""], ["Period", "", ""], ["1995", "", ""], ["1995", "", ""]],
]


def dated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose ledger rows have days and months only; the year stands in the rows above."""
    t = ledger(spark, sf_dir)
    year = (1996 + F.col("statement_id") % 30).cast("string")
    said = lambda cell: F.replace(F.lit(cell), F.lit("{}"), year)
    heads = F.array(*[F.array(*[F.array(*[said(c) for c in row]) for row in rows]) for rows in YEAR_ROWS])
    head = F.element_at(heads, (F.col("statement_id") % len(YEAR_ROWS) + 1).cast("int"))
    titles = F.array(_text_row("Date", "Narration", "Paid Out", "Paid In", "Balance"))
    line = _row(
        F.date_format("txn_date", "dd MMM"), F.col("description"), written_money(F.col("debit")),
        written_money(F.col("credit")), F.format_number("balance", 2),
    )
    rows = t.select(
        "statement_id", page_of(F.col("row_no")).alias("table_no"), "row_no", F.array(line).alias("lines")
    )
    no_rows = F.array().cast("array<array<string>>")
    return stage(_pages(rows, F.concat(head, titles), no_rows), "dated-tables")


NOTES = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]


def positional_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that hide their date column: six note rows follow every transaction."""
    t = ledger(spark, sf_dir)
    date = written_date(F.col("txn_date"), F.col("txn_id"))
    debit, credit = F.col("debit"), F.col("credit")
    numbers = _by_layout(
        F.col("txn_id") % 3,
        [
            _row(written_money(debit, zero="0.00"), written_money(credit, zero="0.00"), F.format_number("balance", 2)),
            _row(F.format_number(debit + credit, 2), F.format_number("balance", 2), F.lit("")),
            _row(F.format_number("balance", 2), F.lit(""), F.lit("")),
        ],
    )
    start = F.concat(_row(date, F.col("description")), numbers)
    lines = F.array(start, *[_text_row("", note, "", "", "") for note in NOTES])
    rows = t.select(
        "statement_id", page_of(F.col("row_no")).alias("table_no"), "row_no", lines.alias("lines")
    )
    head, foot = [F.array(_text_row(w, "", "", "", "")) for w in ("Ledger extract", "End")]
    return stage(_pages(rows, head, foot), "positional-tables")


# ---- text pages -------------------------------------------------------------------------

# Running text has no minus signs: balances are lifted by a fixed sum to stay positive.
LIFT = 10_000_000
LINE_DATES = ["dd/MM/yyyy", "dd-MMM-yyyy", "dd MMM yyyy", "yyyy-MM-dd", "dd-MM-yy"]
SECTION_YEAR = 2000


def _chain(key: Column, values: list[Column]) -> Column:
    return F.element_at(F.array(*values), (key % len(values) + 1).cast("int"))


def ledger_line_pages(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """Single-ledger text: date, narration and one to three amounts per line."""
    t = ledger(spark, sf_dir)
    if which is not None:
        t = t.where(which)
    date = _chain(F.col("txn_id"), [F.date_format("txn_date", f) for f in LINE_DATES])
    size = F.format_number(F.col("debit") + F.col("credit"), 2)
    total = F.format_number(F.col("balance") + LIFT, 2)
    amounts = _chain(
        F.col("txn_id"),
        [
            F.concat_ws("  ", F.format_number("debit", 2), F.format_number("credit", 2), total),
            F.concat_ws("  ", size, total),
            F.concat_ws("  ", size, total),
            total,
        ],
    )
    line = F.concat_ws(" ", date, F.col("description"), amounts)
    note = F.when(F.col("txn_id") % 5 == 0, F.lit("   via the counter"))
    rows = t.select(
        "statement_id",
        (page_of(F.col("row_no")) + 1).alias("page_no"),
        F.struct("row_no", F.concat_ws("\n", line, note).alias("text")).alias("r"),
    )
    body = rows.groupBy("statement_id", "page_no").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return body.select(
        "statement_id",
        "page_no",
        F.concat_ws(
            "\n",
            F.concat(F.lit("Statement of Account   Page No "), F.col("page_no").cast("string")),
            F.lit("Opening Balance 0.00"),
            F.array_join(F.transform("rows", lambda r: r["text"]), "\n"),
            F.lit("Closing page of this statement"),
        ).alias("text"),
    )


def section_of() -> Column:
    """0 deposits, 1 withdrawals, 2 checks."""
    is_check = (F.col("debit") > 0) & (F.col("txn_id") % 16 == 11)
    return F.when(F.col("credit") > 0, 0).when(is_check, 2).otherwise(1)


SECTION_TEXT = [
    ("Deposits and Other Credits of the Period\nTran Date    Text    Amount", "Total Deposits and Other Credits"),
    ("Withdrawals and Other Debits of the Period\nTran Date    Text    Amount", "Total Withdrawals"),
    ("Checks Paid This Period\nTran Date    Check Number    Amount    Reference Number", "Total Checks Paid"),
]


def section_pages(spark: SparkSession, sf_dir: str, which: Column | None = None) -> DataFrame:
    """Sectioned text: page 1 is a summary, the sections follow with two-part dates."""
    t = ledger(spark, sf_dir)
    if which is not None:
        t = t.where(which)
    t = t.withColumn("section", section_of())
    day = F.date_format("txn_date", "MM-dd")
    size = F.format_number(F.col("debit") + F.col("credit"), 2)
    entry = F.concat_ws(
        "\n",
        F.when(F.col("txn_id") % 5 == 0, F.lit("memo of the branch")),
        F.concat(F.col("description"), F.lit("  "), day, F.lit("  $"), size),
    )
    check = F.concat_ws(
        "    ", day, (F.col("txn_id") + 1000).cast("string"), size, F.lpad(F.col("txn_id").cast("string"), 9, "0")
    )
    rows = t.select(
        "statement_id",
        (page_of(F.col("row_no")) * 3 + F.col("section") + 2).alias("page_no"),
        "section",
        F.struct("row_no", F.when(F.col("section") == 2, check).otherwise(entry).alias("text")).alias("r"),
        (F.col("debit") + F.col("credit")).alias("size"),
    )
    body = rows.groupBy("statement_id", "page_no", "section").agg(
        F.array_sort(F.collect_list("r")).alias("rows"), F.sum("size").alias("total")
    )
    pick = lambda i: _by_layout(F.col("section"), [F.lit(s[i]) for s in SECTION_TEXT])
    data = body.select(
        "statement_id",
        "page_no",
        F.concat_ws(
            "\n",
            pick(0),
            F.array_join(F.transform("rows", lambda r: r["text"]), "\n"),
            F.concat(pick(1), F.lit(" $"), F.format_number("total", 2)),
        ).alias("text"),
    )
    summary = rows.select("statement_id").distinct().select(
        "statement_id",
        F.lit(1).cast("long").alias("page_no"),
        F.lit(
            f"Statement Date: August 21, {SECTION_YEAR}\nDaily Balance\nBrought over 01-02 $12.00\n"
        ).alias("text"),
    )
    return summary.unionByName(data)


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the ledger-line pages as boxes; some extra words are too faint to count."""
    pages = ledger_line_pages(spark, sf_dir)
    lines = pages.select(
        "statement_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line", "text")
    )
    words = lines.select(
        "statement_id", "page_no", "line", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("at", "text")
    )
    wobble = F.crc32(F.concat_ws("|", "text", "line", "at").cast("binary")) % 3
    boxes = words.select(
        "statement_id",
        "page_no",
        "text",
        (F.col("at") * 50).cast("double").alias("x"),
        (F.col("line") * 20 + wobble).cast("double").alias("y"),
        F.lit(12.0).alias("h"),
        F.lit("0.9").alias("score"),
    )
    faint = lines.where("line % 7 = 0").select(
        "statement_id",
        "page_no",
        F.lit("smudge").alias("text"),
        F.lit(7.0).alias("x"),
        (F.col("line") * 20).cast("double").alias("y"),
        F.lit(12.0).alias("h"),
        F.lit("0.2").alias("score"),
    )
    unscored = lines.where("line = 1").select(
        "statement_id",
        "page_no",
        F.lit("INR").alias("text"),
        F.lit(900.0).alias("x"),
        (F.col("line") * 20).cast("double").alias("y"),
        F.lit(4.0).alias("h"),
        F.lit("n/a").alias("score"),
    )
    return boxes.unionByName(faint).unionByName(unscored)
