import random
from bisect import bisect_left, bisect_right

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import sketches as s

QUANTILES = {"median": 0.5, "p95": 0.95}


def test_merged_sketches_stay_within_their_errors(spark, tmp_path):
    rows = spark.range(200_000).select(
        (F.col("id") % 12).cast("string").alias("month"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5)).alias("category"),
        F.pmod(F.xxhash64("id"), F.lit(40_000)).alias("account"),
        F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_000)).alias("cents"),
    )
    s.sketched(rows, ["month", "category"], "account", "cents").write.parquet(f"{tmp_path}/sketches")
    stored = spark.read.parquet(f"{tmp_path}/sketches")
    for keys in (["month", "category"], ["category"], []):
        exact = rows.groupBy(*keys).agg(F.count_distinct("account").alias("d"), F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_list("cents")).alias("all"))
        found = {tuple(r[k] for k in keys): r for r in s.estimates(s.merged(stored, keys), keys, QUANTILES).collect()}
        for r in exact.collect():
            got = found[tuple(r[k] for k in keys)]
            assert got.n == r.rows and abs(got.n_distinct - r.d) <= 0.03 * r.d
            for name, q in QUANTILES.items():
                low, high = bisect_left(r["all"], got[name]) / r.rows, bisect_right(r["all"], got[name]) / r.rows
                assert low - 0.015 <= q <= high + 0.015


@pytest.mark.parametrize("block_rows", [7, 50_000])
def test_exact_quantiles(spark, block_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(40)])) for _ in range(300)] + [("one", 5), ("two", 1), ("two", 9)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {r.k: (r.n, r.median, r.p95) for r in s.exact_quantiles(df, "k", "v", QUANTILES, block_rows=block_rows).collect()}
    want = {}
    for k in {"hot", "a", "one", "two"}:
        values = sorted(v for x, v in rows if x == k and v is not None)
        want[k] = (len(values), *(values[max(-(-len(values) * q // 100), 1) - 1] for q in (50, 95)))
    assert got == want


def test_empty_groups(spark):
    none = spark.createDataFrame([], "k string, a long, v long")
    assert s.estimates(s.merged(s.sketched(none, ["k"], "a", "v"), ["k"]), ["k"], QUANTILES).count() == 0
    nulls = spark.createDataFrame([("x", None, None)], "k string, a long, v long")
    (row,) = s.estimates(s.sketched(nulls, ["k"], "a", "v"), ["k"], QUANTILES).collect()
    assert (row.n, row.n_distinct, row.median) == (1, 0, None)
    assert s.exact_quantiles(nulls, "k", "v", QUANTILES).count() == 0
