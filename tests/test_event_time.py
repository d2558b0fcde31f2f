import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import event_time as e

SCHEMA = "id long, ts timestamp, kind string"


def at(s):
    return None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def frame(spark, rows):
    return spark.createDataFrame([(i, at(s), k) for i, s, k in rows], SCHEMA)


def test_late_rows_and_closed_windows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randrange(0, 1000), rng.choice("ab")) for i in range(300)] + [(300, None, "a")]
    deliveries = [[r for r in rows if r[1] is not None and r[1] < 400 and r[0] % 7], [], [r for r in rows if r[1] is None or r[1] >= 400 or not r[0] % 7]]
    folders, latest, late, timely = e.Folders(str(tmp_path)), None, set(), []
    for some in deliveries:
        frame(spark, some).write.mode("append").parquet(folders.landing)
        for _ in range(2):  # draining again without new files changes nothing
            e.drain(spark, folders.landing, folders, schema=frame(spark, []).schema, at="ts", window_s=100, delay_s=150, keys=["kind"], totals={"n": lambda: F.count(F.lit(1))})
        for i, s, k in some:
            if s is None or (latest is not None and s // 100 * 100 + 100 <= latest - 150):
                late.add(i)
            else:
                timely.append((s, k))
        latest = max([s for s, _ in timely], default=None)
    assert len(late) > 5
    assert {r.id for r in spark.read.parquet(folders.late).collect()} == late
    want = {}
    for s, k in timely:
        if s // 100 * 100 + 100 <= latest - 150:
            want[s // 100 * 100, k] = want.get((s // 100 * 100, k), 0) + 1
    closed = spark.read.parquet(folders.windows).collect()
    assert {(int((r.window_start - at(0)).total_seconds()), r.kind): r.n for r in closed} == want and len(closed) == len(want)


@pytest.mark.parametrize("together", [True, False])
def test_files_that_come_twice_count_once(spark, tmp_path, together):
    folders = e.Folders(str(tmp_path))
    held = []
    for n in range(6):
        rows = [(100 * n + i, 100 * n + i, "a") for i in range(100)]
        for again in range(2):
            frame(spark, rows).write.mode("append").parquet(folders.landing)
            if not together or again:
                progress = e.ingest_once(spark, folders.landing, folders, schema=frame(spark, []).schema, at="ts", delay_s=150)
                held += [s["numRowsTotal"] for s in progress]
    ids = [r.id for r in spark.read.parquet(folders.rows).collect()]
    assert sorted(ids) == list(range(600))
    assert max(held) <= 400 and held[-1] <= 300  # the state forgets rows whose time has passed
