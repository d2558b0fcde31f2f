"""Heavy hitters by counters and stored sums that follow changes."""

import random
import uuid
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import heavy, increments
from ledgerloom.session import shared_folder


def plain(rows, n):
    sums, counts = Counter(), Counter()
    for k, w in rows:
        if k is not None and w is not None and w > 0:
            sums[k] += w
            counts[k] += 1
    return [(k, sums[k], counts[k]) for k in sorted(sums, key=lambda k: (-sums[k], k))[:n]]


@pytest.mark.parametrize("counters", [1, 7, 1024])
@pytest.mark.parametrize("n", [1, 5, 40])
def test_heavy_hitters_equal_plain_sums(spark, counters, n):
    rng = random.Random(counters * 100 + n)
    rows = [(f"k{int(rng.paretovariate(0.7)) % 300}", rng.randint(-3, 20)) for _ in range(3000)]
    rows += [("hot", 9)] * 1500 + [(None, 5), ("k1", None), ("only-loss", -4)]
    df = spark.createDataFrame(rows, "k string, w long").repartition(5)
    got = heavy.heavy_hitters(df, "k", "w", n, counters=counters).collect()
    assert [tuple(r) for r in got] == plain(rows, n)


def test_ties_few_keys_and_no_rows(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 1)], "k string, w int")
    assert [r.k for r in heavy.heavy_hitters(df, "k", "w", 2, counters=64).collect()] == ["a", "b"]
    assert [r.k for r in heavy.heavy_hitters(df, "k", "w", 9, counters=64).collect()] == ["a", "b", "c"]
    assert heavy.heavy_hitters(df.limit(0), "k", "w", 9).collect() == []


def test_light_counters_are_left_out(spark):
    rows = spark.range(100_000).select(
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("top"), F.col("id") % 20)).otherwise(F.col("id").cast("string")).alias("_key"),
        F.lit(1).alias("_weight"),
    )
    rows = rows.withColumn("_counter", heavy._counter(F.col("_key"), 4096))
    left = heavy.candidates(rows, 5, 4096)
    # half of the rows are of keys that come once: all but those beside a heavy key are gone
    assert left.count() < 51_000
    assert left.select("_key").distinct().count() < 1000


def store(spark, parts=16):
    return increments.Store(spark, f"{shared_folder(spark)}/sums-{uuid.uuid4().hex}", ["a", "c"], ["v"], parts)


def rows_of(spark, rows):
    return spark.createDataFrame([(i, a, c, Decimal(v) if v is not None else None) for i, a, c, v in rows], "id long, a long, c string, v decimal(18,2)")


def held(s):
    return {(r.a, r.c): (r.v, r.n) for r in s.read().collect()}


def recomputed(rows):
    out = {}
    for _, a, c, v in rows:
        total, n = out.get((a, c), (Decimal(0), 0))
        out[(a, c)] = (total + (Decimal(v) if v is not None else 0), n + 1)
    return out


def test_changes_equal_a_full_recomputation(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 30), rng.choice("xyz"), rng.choice([rng.randint(1, 99), None])) for i in range(600)]
    rows += [(1000 + i, None, None, 1) for i in range(3)]
    s = store(spark)
    s.load(rows_of(spark, rows))
    assert held(s) == recomputed(rows)
    for change in (1, 2, 3):
        moved = set(rng.sample(range(600), 25))
        old = [r for r in rows if r[0] in moved]
        new = [(i, a, rng.choice("xyzw"), v) for i, a, c, v in old]
        rows = [r for r in rows if r[0] not in moved] + new
        s.apply(change, rows_of(spark, old), rows_of(spark, new))
        assert held(s) == recomputed(rows)
    # the last change again, after its own result is there: nothing counts twice
    s.apply(3, rows_of(spark, old), rows_of(spark, new))
    assert held(s) == recomputed(rows)


def test_only_changed_parts_are_read(spark):
    rows = [(i, i, "x", 1) for i in range(400)]
    s = store(spark, 64)
    s.load(rows_of(spark, rows))
    part = lambda a, c: s._placed(spark.createDataFrame([(a, c)], "a long, c string")).first()["_part"]
    touched = {part(7, "x"), part(7, "y")}
    s.apply(1, rows_of(spark, [(7, 7, "x", 1)]), rows_of(spark, [(7, 7, "y", 1)]))
    assert set(s._folders()[1]) == touched
    read = s._current(0, sorted(touched)).inputFiles()
    assert 0 < len(read) <= len(touched) < len(s._current(0, None).inputFiles())
    assert (7, "x") not in held(s) and held(s)[(7, "y")] == (Decimal(1), 1)


def test_unfinished_versions_and_empty_stores(spark):
    s = store(spark)
    with pytest.raises(ValueError):
        s.read()
    s.load(rows_of(spark, [(1, 1, "x", 5)]))
    s.apply(1, rows_of(spark, [(1, 1, "x", 5)]), rows_of(spark, []))
    assert held(s) == {}
    s.apply(2, rows_of(spark, []), rows_of(spark, []))
    assert held(s) == {}
    with pytest.raises(ValueError):
        s.apply(0, rows_of(spark, []), rows_of(spark, []))
    # a version whose job did not finish has no mark and is not read
    rows_of(spark, [(9, 9, "q", 9)]).write.parquet(f"{s.path}/version=7/_part=0")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    mark = hadoop(f"{s.path}/version=7/_SUCCESS")
    assert not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)
    assert held(s) == {}
