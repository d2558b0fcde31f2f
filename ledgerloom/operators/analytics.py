"""Summaries of a labelled ledger, for all statements at once.

Every summary is a partial aggregate on (statement, group): a statement with many rows leaves
each map task as a few rows. Windows run on the aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATEMENT = "statement_id"
TOP_MERCHANTS = 8


def month_of(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("Unknown"))


def _percent(part: Column, total: Column) -> Column:
    base = F.when(total == 0, F.lit(1.0)).otherwise(total.cast("double"))
    return F.round(part.cast("double") * 100 / base, 1)


def _spent(condition: Column | None = None) -> Column:
    paid = F.col("debit") > 0
    return F.when(paid if condition is None else paid & condition, F.col("debit"))


def totals(ledger: DataFrame) -> DataFrame:
    """Sums, net, count and the average debit over rows that have one (0 when none has)."""
    return ledger.groupBy(STATEMENT).agg(*_total_columns())


def _total_columns() -> list[Column]:
    return [
        F.sum("debit").alias("total_debits"),
        F.sum("credit").alias("total_credits"),
        (F.sum("credit") - F.sum("debit")).alias("net_cash_flow"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(
            F.sum(_spent()).cast("double") / F.nullif(F.count(_spent()), F.lit(0)), F.lit(0.0)
        ).alias("avg_debit"),
    ]


def category_summary(ledger: DataFrame) -> DataFrame:
    """Debit sum, count and share of all debits per category."""
    per_category = (
        ledger.where("debit > 0")
        .groupBy(STATEMENT, "category")
        .agg(F.sum("debit").alias("total_amount"), F.count(F.lit(1)).alias("count"))
    )
    # at most one row per category and statement reaches this window
    total = F.sum("total_amount").over(Window.partitionBy(STATEMENT))
    return per_category.withColumn("percentage", _percent(F.col("total_amount"), total))


def channel_summary(ledger: DataFrame) -> DataFrame:
    """Debit sum and count per channel over all rows; rows without a channel drop out."""
    per_channel = (
        ledger.where(F.col("channel").isNotNull())
        .groupBy(STATEMENT, F.when(F.col("channel") == "", F.lit("Other")).otherwise(F.col("channel")).alias("channel"))
        .agg(F.sum("debit").alias("total_amount"), F.count(F.lit(1)).alias("count"))
    )
    total = F.sum("total_amount").over(Window.partitionBy(STATEMENT))
    return per_channel.withColumn(
        "bar_percent", F.least(_percent(F.col("total_amount"), total), F.lit(100.0))
    )


def with_merchant(rows: DataFrame) -> DataFrame:
    """Rows whose merchant is known.

    An explode of at most one value: a filter would be pushed below the merchant expression
    and evaluate it again.
    """
    named = F.filter(F.array("merchant"), lambda m: m != "")
    others = [c for c in rows.columns if c != "merchant"]
    return rows.select(*others, F.explode(named).alias("merchant"))


def top_merchants(ledger: DataFrame, n: int = TOP_MERCHANTS) -> DataFrame:
    """The n merchants with the largest debit sum of each statement.

    The rank filter is applied before the shuffle as well, so each task sends at most n rows
    per statement, however many merchants it has.
    """
    per_merchant = (
        with_merchant(ledger.where("debit > 0").select(STATEMENT, "merchant", "debit"))
        .groupBy(STATEMENT, "merchant")
        .agg(F.sum("debit").alias("total_amount"), F.count(F.lit(1)).alias("count"))
    )
    rank = F.row_number().over(
        Window.partitionBy(STATEMENT).orderBy(F.desc("total_amount"), F.asc("merchant"))
    )
    return per_merchant.withColumn("rank", rank).where(F.col("rank") <= n)


def monthly_trend(ledger: DataFrame) -> DataFrame:
    return (
        ledger.groupBy(STATEMENT, month_of(F.col("txn_date")).alias("month"))
        .agg(F.sum("debit").alias("total_debit"), F.sum("credit").alias("total_credit"))
        .withColumn("net", F.col("total_credit") - F.col("total_debit"))
    )


def balance_health(ledger: DataFrame) -> DataFrame:
    """Verified rows, all rows and their share; a missing flag counts as verified."""
    counted = ledger.groupBy(STATEMENT).agg(*_health_columns())
    return counted.withColumn("percentage", _percent(F.col("verified"), F.col("total")))


def health_of_totals(totals: DataFrame) -> DataFrame:
    """``balance_health`` from ``audit.audited_totals``: no row is read again."""
    total = F.col("total_transactions")
    counted = totals.select(STATEMENT, (total - F.col("balance_mismatches_count")).alias("verified"), total.alias("total"))
    return counted.withColumn("percentage", _percent(F.col("verified"), F.col("total")))


def _health_columns() -> list[Column]:
    verified = F.sum(F.coalesce(F.col("balance_verified"), F.lit(True)).cast("long"))
    return [verified.alias("verified"), F.count(F.lit(1)).alias("total")]


def report_for_all(statements: DataFrame, ledger: DataFrame) -> DataFrame:
    """Totals and health of every known statement; one without rows gets zeros and 100 %."""
    summed = ledger.groupBy(STATEMENT).agg(*_total_columns(), *_health_columns())
    summed = summed.withColumn("percentage", _percent(F.col("verified"), F.col("total")))
    zero = F.lit(0)
    return statements.join(summed, STATEMENT, "left").select(
        STATEMENT,
        *[
            F.coalesce(F.col(c), zero).alias(c)
            for c in ("total_debits", "total_credits", "net_cash_flow", "transaction_count", "verified", "total")
        ],
        F.coalesce("percentage", F.lit(100.0)).alias("percentage"),
        F.col("avg_debit"),
    )


def report_cube(ledger: DataFrame) -> DataFrame:
    """Category, month and grand totals of the whole book from one pass over the ledger."""
    rows = ledger.select(
        F.when(F.col("debit") > 0, F.col("category")).alias("category"),
        month_of(F.col("txn_date")).alias("month"),
        "debit",
        "credit",
    )
    category, month = F.col("category"), F.col("month")
    grouped = rows.groupingSets([[category], [month], []], category, month).agg(
        F.grouping_id().alias("level"),
        F.sum("debit").alias("total_debit"),
        F.sum("credit").alias("total_credit"),
        F.count(F.lit(1)).alias("count"),
    )
    # level 1: by category, 2: by month, 3: everything
    name = F.when(F.col("level") == 1, F.lit("category")).when(
        F.col("level") == 2, F.lit("month")
    ).otherwise(F.lit("total"))
    return grouped.where((F.col("level") != 1) | category.isNotNull()).select(
        name.alias("level"),
        F.coalesce(category, month, F.lit("all")).alias("item"),
        "total_debit",
        "total_credit",
        "count",
    )
