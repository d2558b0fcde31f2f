"""Heavy hitters: the keys with the largest sums, without an aggregate over all keys.

A first pass adds every row to one of a bounded number of counters, by the hash of its key. A
counter is never below the sum of any of its keys, so once the sums of a few good candidates are
known exactly, every counter below the least of them holds no key that could be among the first.
Only rows of the counters that are left are grouped by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

COUNTERS = 1 << 16


def _counter(key: Column, counters: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(counters))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("_key").agg(F.sum("_weight").alias("total"), F.count(F.lit(1)).alias("count"))


def candidates(rows: DataFrame, n: int, counters: int = COUNTERS) -> DataFrame:
    """The rows (_key, _weight, _counter) of all counters that may hold one of the n first keys.

    ``rows`` is read three times: for the counters, for the keys of the n largest of them, which
    give the threshold, and for the result. What is broadcast is at most ``counters`` numbers.
    """
    held = stage(rows.groupBy("_counter").agg(F.sum("_weight").alias("held")), "counters")
    first = held.orderBy(F.desc("held"), "_counter").limit(n).select("_counter")
    # a counter in use has at least one key: n counters, if there are as many, give n keys or more
    sums = _summed(rows.join(F.broadcast(first), "_counter", "left_semi")).orderBy(F.desc("total")).limit(n)
    seen = sums.agg(F.count(F.lit(1)).alias("keys"), F.min("total").alias("least")).first()
    left = held if seen["keys"] < n else held.where(F.col("held") >= F.lit(seen["least"]))
    return rows.join(F.broadcast(left.select("_counter")), "_counter", "left_semi")


def heavy_hitters(rows: DataFrame, key: str, weight: str, n: int, *, counters: int = COUNTERS) -> DataFrame:
    """``(key, total, count)``: the n keys with the largest sum of ``weight``, ties by key.

    Exact. Rows count whose key is not null and whose weight is above zero: sums of parts never
    exceed sums of wholes then. The fewer keys hold most of the weight, the fewer rows are grouped
    by key; where all keys weigh alike, all counters stay and it is a plain aggregate. A key of
    very many rows is one partial sum of each task.
    """
    known = rows.where(F.col(key).isNotNull() & (F.col(weight) > 0))
    known = known.select(F.col(key).alias("_key"), F.col(weight).alias("_weight"))
    known = stage(known.withColumn("_counter", _counter(F.col("_key"), counters)), "weights")
    found = _summed(candidates(known, n, counters)).orderBy(F.desc("total"), "_key").limit(n)
    return found.select(F.col("_key").alias(key), "total", "count")
