"""Running-balance audit of a ledger with dense positions ``row_no`` = 1..n per statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_ROWS, with_previous

TOLERANCE = 0.05


def checked_steps(ledger: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Both balance formulas of every row against the row before it.

    One shuffle on (statement, block) and one window.
    """
    rows = with_previous(
        ledger, "statement_id", "row_no", ["balance", "debit", "credit"], block_rows=block_rows
    )
    forward = F.col("prev_balance") - F.col("debit") + F.col("credit")
    reverse = F.col("prev_balance") + F.col("prev_debit") - F.col("prev_credit")
    return rows.withColumn("forward", forward).withColumn("reverse", reverse)


def _fits(expected: str):
    gap = F.abs(F.col(expected) - F.col("balance"))
    return F.coalesce(gap < F.lit(TOLERANCE).cast("decimal(4,2)"), F.lit(False))


def direction(steps: DataFrame) -> DataFrame:
    """Votes of each statement: newest-first only when strictly more steps fit that way.

    Votes are summed per block first (already co-located), then per statement.
    """
    per_block = steps.groupBy("statement_id", "block").agg(
        F.sum(_fits("forward").cast("long")).alias("f"), F.sum(_fits("reverse").cast("long")).alias("r")
    )
    return per_block.groupBy("statement_id").agg(
        F.sum("f").alias("forward_matches"),
        F.sum("r").alias("reverse_matches"),
        F.max("block").alias("last_block"),
    ).withColumn("is_reverse", F.col("reverse_matches") > F.col("forward_matches"))


def audit(ledger: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``is_reverse``, ``expected`` and ``balance_verified`` to every ledger row.

    The verdict of a statement is copied to each of its blocks, so the join back runs on
    (statement, block): the rows stay where the window left them.
    """
    steps = checked_steps(ledger, block_rows=block_rows)
    verdict = direction(steps).select(
        "statement_id", F.explode(F.sequence(F.lit(0).cast("long"), "last_block")).alias("block"), "is_reverse"
    )
    expected = F.when(F.col("is_reverse"), F.col("reverse")).otherwise(F.col("forward"))
    good = F.when(F.col("is_reverse"), _fits("reverse")).otherwise(_fits("forward"))
    return (
        steps.join(verdict, ["statement_id", "block"])
        .withColumn("expected", expected)
        .withColumn("balance_verified", (F.col("row_no") == 1) | good)
    )


def anomalies(audited: DataFrame) -> DataFrame:
    """One text per row whose balance does not follow from the row before it."""
    date = F.coalesce(F.date_format("txn_date", "yyyy-MM-dd"), F.lit(""))
    text = lambda c: c.cast("decimal(20,2)").cast("string")
    two = lambda c: text(F.col(c))
    gap = text(F.abs(F.col("expected") - F.col("balance")))
    forward = F.concat(
        F.lit("Row "), F.col("row_no").cast("string"), F.lit(" ("), date,
        F.lit("): Balance mismatch! Expected "), two("expected"),
        F.lit(" (from prev "), two("prev_balance"), F.lit(" - Dr "), two("debit"),
        F.lit(" + Cr "), two("credit"), F.lit("), Found "), two("balance"),
        F.lit(" (diff: "), gap, F.lit(")"),
    )
    reverse = F.concat(
        F.lit("Row "), F.col("row_no").cast("string"), F.lit(" ("), date,
        F.lit("): Reverse ledger mismatch! Expected "), two("expected"),
        F.lit(", Found "), two("balance"),
    )
    return audited.where(~F.col("balance_verified")).select(
        "statement_id",
        "row_no",
        F.when(F.col("is_reverse"), reverse).otherwise(forward).alias("anomaly"),
    )


def _mismatches(expected: str):
    return F.sum(((F.col("row_no") != 1) & ~_fits(expected)).cast("long"))


def audited_totals(ledger: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What ``statement_totals(audit(ledger))`` says, and the votes, without judging each row.

    Findings are counted for both directions in the aggregate that counts the votes; the
    direction picks one of them. One shuffle of the rows, on (statement, block), and no join.
    """
    steps = checked_steps(ledger, block_rows=block_rows)
    per_block = steps.groupBy("statement_id", "block").agg(
        F.sum(_fits("forward").cast("long")).alias("f"),
        F.sum(_fits("reverse").cast("long")).alias("r"),
        _mismatches("forward").alias("f_off"),
        _mismatches("reverse").alias("r_off"),
        F.count(F.lit(1)).alias("n"),
        F.sum("debit").alias("d"),
        F.sum("credit").alias("c"),
    )
    summed = per_block.groupBy("statement_id").agg(*[F.sum(x).alias(x) for x in ("f", "r", "f_off", "r_off", "n", "d", "c")])
    is_reverse = F.col("r") > F.col("f")
    return summed.select(
        "statement_id",
        F.col("n").alias("total_transactions"),
        F.col("d").alias("total_debits"),
        F.col("c").alias("total_credits"),
        (F.col("c") - F.col("d")).alias("net_cash_flow"),
        F.when(is_reverse, F.col("r_off")).otherwise(F.col("f_off")).alias("balance_mismatches_count"),
        is_reverse.alias("is_reverse"),
    )


def statement_totals(audited: DataFrame) -> DataFrame:
    """Rows, sums, net and number of audit findings per statement."""
    return audited.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("debit").alias("total_debits"),
        F.sum("credit").alias("total_credits"),
        (F.sum("credit") - F.sum("debit")).alias("net_cash_flow"),
        F.sum((~F.col("balance_verified")).cast("long")).alias("balance_mismatches_count"),
    )


def derived_balances(ledger: DataFrame, *, newest_first: bool = False) -> DataFrame:
    """Opening and closing balance from the ledger rows.

    Opening is the first row's balance without its own movement, closing the last row's
    balance; both only where some balance is positive. ``newest_first=True`` reads
    ``is_reverse`` and swaps first and last for statements listed newest first.
    """
    place = F.col("row_no")
    if newest_first:
        place = F.when(F.col("is_reverse"), -place).otherwise(place)
    before = F.col("balance") + F.col("debit") - F.col("credit")
    summed = ledger.groupBy("statement_id").agg(
        F.min_by(before, place).alias("_opening"),
        F.max_by("balance", place).alias("_closing"),
        F.max("balance").alias("_highest"),
        F.sum("debit").alias("total_debits"),
        F.sum("credit").alias("total_credits"),
    )
    positive = F.col("_highest") > 0
    return summed.select(
        "statement_id",
        F.when(positive, F.col("_opening")).alias("opening_balance"),
        F.when(positive, F.col("_closing")).alias("closing_balance"),
        "total_debits",
        "total_credits",
    )


def with_stated_balances(derived: DataFrame, stated: DataFrame) -> DataFrame:
    """Stated balances win over derived ones; a closing balance that neither gives is summed."""
    joined = derived.join(
        stated.select(
            "statement_id",
            F.col("opening_balance").alias("_stated_opening"),
            F.col("closing_balance").alias("_stated_closing"),
        ),
        "statement_id",
        "left",
    )
    opening = F.coalesce("_stated_opening", "opening_balance")
    closing = F.coalesce(
        F.col("_stated_closing"),
        F.col("closing_balance"),
        opening + F.col("total_credits") - F.col("total_debits"),
    )
    return joined.select(
        "statement_id",
        opening.alias("opening_balance"),
        closing.alias("closing_balance"),
        "total_debits",
        "total_credits",
    )


def identity(balances: DataFrame) -> DataFrame:
    """Check opening + credits - debits = closing within the tolerance."""
    gap = (
        F.col("opening_balance") + F.col("total_credits") - F.col("total_debits") - F.col("closing_balance")
    )
    return balances.withColumn("gap", gap).withColumn(
        "identity_holds", F.abs(gap) < F.lit(TOLERANCE).cast("decimal(4,2)")
    )
