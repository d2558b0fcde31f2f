"""The running-balance audit of statements whose rows come in several files, in any order.

State is kept for each (statement, block of rows): which rows have come, and the values of those
at the edges of what has come without a gap. A row is compared with the row before it once both
are there, whichever came last; a row that comes again adds nothing. Outcomes are appended to a
sink, each once, and the votes of a statement are summed when they are read.

Statements are many and short, so states are rows of a table, not groups of a stateful stream:
each batch sorts its rows in behind the states of their blocks and one pass over a partition
settles all of them. States lie in parts and versions; a batch reads and writes the parts it touches.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import TOLERANCE
from ..operators.blocks import BLOCK_ROWS, block_of
from ..session import stage, unstage

OUTCOME = "statement_id long, txn_id long, row_no long, forward boolean, reverse boolean"
STATE = "statement_id long, block long, ranges string"
STEP = f"{OUTCOME}, block long, ranges string"
# Parts of the states: at most as many numbers reach the driver.
PARTS = 256
_GAP = Decimal(str(TOLERANCE))


class Ranges:
    """The rows of one block that have come, as ranges without gaps.

    A range is [low, high, head, tail]: tail has the values of its last row; head those of its
    first one while the row before it is missing, else None. Values are [txn_id, balance, debit,
    credit], money as text.
    """

    def __init__(self, text: str = "[]") -> None:
        held = json.loads(text)
        self.lows = [r[0] for r in held]
        self.by_low = {r[0]: r for r in held}
        self.by_high = {r[1]: r for r in held}

    def text(self) -> str:
        return json.dumps([self.by_low[low] for low in self.lows])

    def has(self, row_no: int) -> bool:
        at = bisect_right(self.lows, row_no)
        return at > 0 and row_no <= self.by_low[self.lows[at - 1]][1]

    def add(self, row_no: int, values: list, own: bool) -> Iterator[tuple[int, int, bool, bool]]:
        """Take a row in; yields (txn_id, row_no, forward, reverse) of every row that this settles.

        ``own`` is false for the last row of the block before, which is only compared with.
        """
        if self.has(row_no):
            return
        left, right = self.by_high.pop(row_no - 1, None), self.by_low.pop(row_no + 1, None)
        if own and row_no == 1:
            yield values[0], row_no, False, False
        elif own and left:
            yield values[0], row_no, *_fits(left[3], values)
        if right and right[2] is not None:
            yield right[2][0], row_no + 1, *_fits(values, right[2])
        waits = None if row_no == 1 or not own else values
        whole = [left[0] if left else row_no, right[1] if right else row_no, left[2] if left else waits, right[3] if right else values]
        if right:
            del self.lows[bisect_right(self.lows, row_no + 1) - 1]
        if not left:
            self.lows.insert(bisect_right(self.lows, row_no), row_no)
        self.by_low[whole[0]] = self.by_high[whole[1]] = whole


def _fits(before: list, row: list) -> tuple[bool, bool]:
    """Whether the balance follows from the row before, listed oldest first or newest first."""
    _, then, out, into = (None if x is None else Decimal(x) for x in before)
    _, now, debit, credit = (None if x is None else Decimal(x) for x in row)
    known = None not in (then, now)
    forward = known and None not in (debit, credit) and abs(then - debit + credit - now) < _GAP
    reverse = known and None not in (out, into) and abs(then + out - into - now) < _GAP
    return forward, reverse


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Outcomes and new states of rows sorted by (statement, block, row), the old state of a block first."""
    names = [c.split()[0] for c in STEP.split(", ")]
    at, ranges = None, Ranges()
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if (r.statement_id, r.block) != at:
                if at:
                    out.append((at[0], None, None, None, None, at[1], ranges.text()))
                at, ranges = (r.statement_id, r.block), Ranges(r.ranges if r.row_no == 0 else "[]")
            if r.row_no > 0:
                values = [int(r.txn_id), *(None if x is None or x != x else x for x in (r.balance, r.debit, r.credit))]
                out += [(at[0], *found, None, None) for found in ranges.add(int(r.row_no), values, bool(r.own))]
        yield _frame(out, names)
    if at:
        yield _frame([(at[0], None, None, None, None, at[1], ranges.text())], names)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names, dtype=object)


def _states(spark: SparkSession, path: str, before: int, parts: list[int]) -> DataFrame:
    """States of the given parts as the last finished batch before ``before`` left them."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    newest: dict[int, tuple[int, str]] = {}
    for version in files.listStatus(hadoop(path)) if files.exists(hadoop(path)) else []:
        number = int(version.getPath().getName().partition("=")[2])
        if number >= before or not files.exists(hadoop(version.getPath(), "_SUCCESS")):
            continue
        for entry in files.listStatus(version.getPath()):
            name, _, part = entry.getPath().getName().partition("=")
            if name == "_part" and int(part) in parts:
                newest[int(part)] = max(newest.get(int(part), (-1, "")), (number, entry.getPath().toString()))
    if not newest:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*[p for _, p in newest.values()])


def _settle_batch(sent: DataFrame, batch: int, sink: str, path: str) -> None:
    """One batch; run again it replaces what it wrote."""
    spark = sent.sparkSession
    part = F.pmod(F.xxhash64("statement_id", "block"), F.lit(PARTS)).cast("int")
    sent = stage(sent, "running-audit-rows")
    touched = sorted(r[0] for r in sent.select(part).distinct().collect())
    zero = F.lit(0).cast("long")  # rows count from 1
    held = _states(spark, path, batch, touched).withColumns({"row_no": zero, "txn_id": zero, "own": F.lit(False)})
    rows = sent.withColumn("ranges", F.lit(None).cast("string")).unionByName(held, allowMissingColumns=True)
    sorted_in = rows.repartition("statement_id", "block").sortWithinPartitions("statement_id", "block", "row_no")
    done = stage(sorted_in.mapInPandas(_settle, STEP), "running-audit")
    outcomes = [c.split()[0] for c in OUTCOME.split(", ")]
    done.where("ranges is null").select(*outcomes).write.mode("overwrite").parquet(f"{sink}/batch={batch}")
    states = done.where("ranges is not null").select("statement_id", "block", "ranges", part.alias("_part"))
    states.repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{path}/version={batch}")
    for staged in (sent, done):
        unstage(staged)


def settle_stream(spark: SparkSession, landing: str, sink: str, checkpoint: str, *, schema, block_rows: int = BLOCK_ROWS) -> None:
    """Settle the rows of all new files of ``landing`` and append the outcomes to ``sink``.

    Rows are (statement_id, txn_id, row_no, balance, debit, credit), row_no from 1 without gaps
    once all have come; of rows with one row_no the first to come counts. The last row of a block
    also goes to the next one, so a statement of any size is spread over tasks and its state is
    bounded by the rows of a block.
    """
    home = block_of(F.col("row_no"), block_rows)
    money = [F.col(c).cast("decimal(18,2)").cast("string").alias(c) for c in ("balance", "debit", "credit")]
    sent = (
        spark.readStream.schema(schema)
        .parquet(landing)
        .where("statement_id is not null and row_no >= 1")
        .select("statement_id", F.coalesce("txn_id", F.lit(0)).alias("txn_id"), "row_no", *money, home.alias("home"))
        .withColumn("block", F.explode(F.when(F.col("row_no") % block_rows == 0, F.array("home", F.col("home") + 1)).otherwise(F.array("home"))))
        .withColumn("own", F.col("block") == F.col("home"))
    )
    running = (
        sent.drop("home")
        .writeStream.foreachBatch(lambda rows, batch: _settle_batch(rows, batch, sink, f"{checkpoint}/ranges"))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def verdicts(spark: SparkSession, sink: str) -> DataFrame:
    """(statement_id, txn_id, row_no, is_reverse, balance_verified) of every row that is settled so far.

    Statements are newest first only where strictly more rows fit that way; the first row of a
    statement is always verified.
    """
    rows = spark.read.schema(OUTCOME).parquet(sink)
    votes = rows.groupBy("statement_id").agg(F.count_if("forward").alias("f"), F.count_if("reverse").alias("r"))
    told = rows.join(votes.select("statement_id", (F.col("r") > F.col("f")).alias("is_reverse")), "statement_id")
    good = F.when(F.col("is_reverse"), F.col("reverse")).otherwise(F.col("forward"))
    return told.select("statement_id", "txn_id", "row_no", "is_reverse", ((F.col("row_no") == 1) | good).alias("balance_verified"))
