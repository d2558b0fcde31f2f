"""Result layouts and sinks: CSV, the four report sheets and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

# Label column of the overview sheet, in order.
OVERVIEW_LABELS = [
    "Bank Name", "Account Holder", "Account Number", "IFSC Code", "Branch", "Statement Period",
    "PDF Detection Type", "Total Transactions", "Total Debits (Withdrawals)",
    "Total Credits (Deposits)", "Net Cash Flow", "Opening Balance", "Closing Balance",
    "Balance Audit Status",
]


def _text(c: str, default: str = ""):
    return F.when(F.length(c) > 0, F.col(c)).otherwise(F.lit(default))


def _date():
    return F.coalesce(F.date_format("txn_date", "yyyy-MM-dd"), F.lit(""))


def csv_rows(ledger: DataFrame) -> DataFrame:
    """The thirteen CSV columns; missing texts are empty, a missing audit flag is true."""
    return ledger.select(
        "statement_id",
        "row_no",
        _date().alias("Date"),
        F.col("description").alias("Description"),
        _text("merchant").alias("Merchant"),
        _text("channel").alias("Channel"),
        F.col("debit").alias("Debit"),
        F.col("credit").alias("Credit"),
        F.col("balance").alias("Balance"),
        F.col("category").alias("Category"),
        _text("sub_category").alias("SubCategory"),
        F.col("confidence").alias("Confidence"),
        F.col("classification_method").alias("ClassificationMethod"),
        F.coalesce("balance_verified", F.lit(True)).alias("BalanceVerified"),
        _text("chq_ref_no").alias("RefNo"),
    )


def sheet_transactions(ledger: DataFrame) -> DataFrame:
    """The transactions sheet; zero amounts are blank, a missing audit flag is a mismatch."""
    blank_zero = lambda c: F.when(F.col(c) > 0, F.col(c).cast("string")).otherwise(F.lit(""))
    return ledger.select(
        "statement_id",
        "row_no",
        _date().alias("Date"),
        F.col("description").alias("Description"),
        _text("merchant", "-").alias("Merchant / Entity"),
        _text("channel", "-").alias("Channel"),
        blank_zero("debit").alias("Debit (Dr)"),
        blank_zero("credit").alias("Credit (Cr)"),
        F.col("balance").alias("Balance"),
        F.col("category").alias("Assigned Category"),
        _text("sub_category", "-").alias("Sub-Category"),
        F.concat(F.floor(F.col("confidence") * 100).cast("int").cast("string"), F.lit("%")).alias("Confidence"),
        F.col("classification_method").alias("Classification Method"),
        F.when(F.coalesce("balance_verified", F.lit(False)), F.lit("Verified"))
        .otherwise(F.lit("Mismatch"))
        .alias("Audit Verified"),
    )


def sheet_category(summary: DataFrame) -> DataFrame:
    return summary.select(
        "statement_id",
        F.col("category").alias("Category"),
        F.col("total_amount").alias("Total Spent (Debit)"),
        F.col("count").alias("Txn Count"),
        F.concat(F.col("percentage").cast("string"), F.lit("%")).alias("% of Expenses"),
    )


def sheet_monthly(trend: DataFrame) -> DataFrame:
    return trend.select(
        "statement_id",
        F.col("month").alias("Month"),
        F.col("total_debit").alias("Total Debits (Expenses)"),
        F.col("total_credit").alias("Total Credits (Income)"),
        F.col("net").alias("Net Savings / Flow"),
    )


def sheet_overview(statements: DataFrame) -> DataFrame:
    """Fourteen label/value rows per statement, unpivoted without a shuffle."""
    rupees = lambda c: F.concat(F.lit("₹ "), F.format_number(c, 2))
    stated = lambda c: F.when(F.col(c).isNotNull(), rupees(c)).otherwise(F.lit("N/A"))
    mismatches = F.col("balance_mismatches_count")
    values = [
        F.col("bank_name"),
        F.col("account_holder"),
        F.col("account_number"),
        _text("ifsc_code", "N/A"),
        _text("branch", "N/A"),
        F.concat(_text("statement_period_start", "N/A"), F.lit(" to "), _text("statement_period_end", "N/A")),
        F.col("file_type"),
        F.col("total_transactions").cast("string"),
        rupees("total_debits"),
        rupees("total_credits"),
        rupees("net_cash_flow"),
        stated("opening_balance"),
        stated("closing_balance"),
        F.when(mismatches == 0, F.lit("100% Reconciled")).otherwise(
            F.concat(mismatches.cast("string"), F.lit(" Discrepancies Flagged"))
        ),
    ]
    pairs = F.array(
        *[F.struct(F.lit(label).alias("label"), v.alias("value")) for label, v in zip(OVERVIEW_LABELS, values)]
    )
    return statements.select(
        "statement_id", F.posexplode(pairs).alias("position", "pair")
    ).select("statement_id", (F.col("position") + 1).alias("position"), "pair.label", "pair.value")


# Rows of one statement that share one nested result; longer statements get several parts.
RESULT_PART_ROWS = 10_000


def nested_result(
    ledger: DataFrame, statements: DataFrame, anomalies: DataFrame | None = None, *, part_rows: int = RESULT_PART_ROWS
) -> DataFrame:
    """Nested results: account details, totals and ordered transactions of each statement.

    A statement longer than ``part_rows`` is split into numbered parts, so no result row (and
    no task) has to hold a whole large statement. ``anomalies(statement_id, row_no, anomaly)`` come
    in the part of their row, those of no row in part 0; a part without any has an empty array.
    """
    txn = [c for c in ledger.columns if c not in ("statement_id", "block")]
    part = F.floor((F.col("row_no") - 1) / part_rows).cast("long")
    grouped = ledger.groupBy("statement_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("row_no", *[c for c in txn if c != "row_no"]))).alias("transactions")
    )
    details = [c for c in statements.columns if c != "statement_id"]
    if anomalies is not None:
        at = F.coalesce(F.floor((F.col("row_no") - 1) / part_rows), F.lit(0)).cast("long")
        notes = anomalies.groupBy("statement_id", at.alias("part")).agg(
            F.array_sort(F.collect_list(F.struct("row_no", "anomaly"))).alias("notes")
        )
        texts = F.transform("notes", lambda n: n["anomaly"])
        grouped = grouped.join(notes, ["statement_id", "part"], "full").withColumn("notes", texts)
    joined = statements.select("statement_id", F.struct(*details).alias("metadata")).join(
        grouped, "statement_id", "left"
    )
    if anomalies is None:
        return joined
    none = F.array().cast("array<string>")
    return joined.withColumn("anomalies", F.coalesce("notes", none)).drop("notes")


def _by_statement(df: DataFrame) -> DataFrame:
    """Spread rows so that one statement is written by many tasks when it is large."""
    return df.repartitionByRange("statement_id", "row_no").sortWithinPartitions("statement_id", "row_no")


def write_csv(ledger: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """CSV with header. Range partitioning on (statement, row) keeps a statement's rows together,
    yet cuts a large one over several files; folders per statement would not scale to millions."""
    rows = _by_statement(csv_rows(ledger))
    rows.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def write_report(sheets: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per sheet."""
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def ledger_to_json(ledger: DataFrame):
    """One JSON text per ledger row."""
    return ledger.select(F.to_json(F.struct(*ledger.columns)).alias("json"))


LEDGER_JSON = (
    "statement_id long, txn_id long, row_no long, txn_date date, description string, "
    "debit decimal(18,2), credit decimal(18,2), balance decimal(18,2), type string"
)


def ledger_from_json(texts: DataFrame, schema: str = LEDGER_JSON) -> DataFrame:
    """Typed ledger rows from JSON texts; a malformed row fails the job."""
    return texts.select(F.from_json("json", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
