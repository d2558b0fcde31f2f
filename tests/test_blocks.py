"""Block-wise windows against plain windows, with one key that holds a third of the rows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import analytics, audit
from ledgerloom.operators.blocks import (
    block_by_splits, block_of, hot_splits, number_rows, scan, with_previous,
)


def skewed(spark, n=3000):
    rnd = random.Random(5)
    rows, at = [], {}
    for _ in range(n):
        key = "hot" if rnd.random() < 0.35 else f"k{rnd.randrange(60)}"
        at[key] = at.get(key, 0) + 1
        rows.append((key, at[key], rnd.randrange(100), rnd.randrange(50) if rnd.random() < 0.1 else None))
    return spark.createDataFrame(rows, "key string, pos long, v long, maybe long")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_scan_equals_plain_window(spark):
    df = skewed(spark).withColumn("block", block_of(F.col("pos"), 50))
    w = Window.partitionBy("key").orderBy("pos")
    so_far, prior = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "key", "pos", F.sum("v").over(so_far).alias("s"), F.last("maybe", True).over(so_far).alias("l"),
        F.last("v", True).over(prior).alias("p"), F.sum("v").over(Window.partitionBy("key")).alias("t"),
    )
    got = scan(
        df, ["key"], ["pos"], sums={"s": F.col("v")}, latest={"l": F.col("maybe")}, before={"p": F.col("v")},
        whole={"t": F.col("v")},
    )
    cols = ("key", "pos", "s", "l", "p", "t")
    assert rows_of(got, *cols) == rows_of(want, *cols)


def test_no_block_holds_more_than_its_share(spark):
    df = skewed(spark).withColumn("block", block_of(F.col("pos"), 50))
    assert df.groupBy("key", "block").count().agg(F.max("count")).first()[0] <= 50


def test_previous_row_across_blocks(spark):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("pos")
    want = df.select("key", "pos", F.lag("v").over(w).alias("prev_v"))
    got = with_previous(df, "key", "pos", ["v"], block_rows=7)
    assert rows_of(got, "key", "pos", "prev_v") == rows_of(want, "key", "pos", "prev_v")


def test_hot_keys_are_split_and_numbered(spark):
    df = skewed(spark)
    splits = hot_splits(df, "key", F.col("v"), rows=500)
    assert [r.key for r in splits.collect()] == ["hot"]
    placed = block_by_splits(df, "key", F.col("v"), splits)
    assert placed.where("key = 'hot'").select("block").distinct().count() > 20
    got = number_rows(placed, ["key"], ["v", "pos"])
    want = df.select("key", "pos", F.row_number().over(Window.partitionBy("key").orderBy("v", "pos")).cast("long").alias("row_no"))
    assert rows_of(got, "key", "pos", "row_no") == rows_of(want, "key", "pos", "row_no")


def test_audit_is_the_same_in_small_blocks(spark):
    rnd = random.Random(9)
    rows = []
    for s, n in [("hot", 400), ("a", 30), ("b", 1), ("rev", 45)]:
        balance, part = 1000.0, []
        for i in range(n):
            debit = rnd.randrange(1, 90)
            balance -= debit
            part.append([s, float(debit), 0.0, balance + (5 if rnd.random() < 0.1 else 0)])
        if s == "rev":
            part.reverse()
        rows += [(p[0], i, p[1], p[2], p[3]) for i, p in enumerate(part, 1)]
    df = spark.createDataFrame(rows, "statement_id string, row_no long, debit double, credit double, balance double")
    for c in ("debit", "credit", "balance"):
        df = df.withColumn(c, F.col(c).cast("decimal(18,2)"))
    whole, cut = audit.audit(df), audit.audit(df, block_rows=8)
    totals = audit.statement_totals(whole).orderBy("statement_id").collect()
    health = analytics.balance_health(whole).orderBy("statement_id").collect()
    for block_rows in (8, 50_000):
        summed = audit.audited_totals(df, block_rows=block_rows).orderBy("statement_id")
        assert summed.drop("is_reverse").collect() == totals
        assert analytics.health_of_totals(summed).orderBy("statement_id").collect() == health
    cols = ("statement_id", "row_no", "is_reverse", "balance_verified")
    assert rows_of(whole, *cols) == rows_of(cut, *cols)
    verdicts = {r.statement_id: r.is_reverse for r in whole.select("statement_id", "is_reverse").distinct().collect()}
    assert verdicts == {"hot": False, "a": False, "b": False, "rev": True}
