import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import temporal as t


def at(s):
    return None if s is None else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def plain_asof(left, right, direction, tolerance):
    out = []
    for k, s, name in left:
        best = None
        for rk, rs, tie in right:
            if k is None or s is None or rk != k or rs is None:
                continue
            gap = rs - s
            if (direction == "backward" and gap > 0) or (direction == "forward" and gap < 0):
                continue
            if tolerance is not None and abs(gap) > tolerance:
                continue
            place = (abs(gap), gap > 0, -tie)
            if best is None or place < best[0]:
                best = (place, tie)
        out.append((k, s, name, best and best[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction", t.DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof_equals_comparing_all(spark, direction, tolerance):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None]
    left = [(rng.choice(keys), rng.choice([None, *range(60)]), f"r{i % 40}") for i in range(120)]
    right = [(rng.choice(keys), rng.choice([None, *range(-5, 70, 3)]), i) for i in range(60)]
    lf = spark.createDataFrame([(k, at(s), n, "clash") for k, s, n in left], "k string, at timestamp, name string, block string")
    rf = spark.createDataFrame([(k, at(s), i, 0) for k, s, i in right], "k string, at timestamp, tie long, block int")
    found = t.asof_join(lf, rf, "k", "at", "at", tie="tie", tolerance_s=tolerance, direction=direction, block_rows=10)
    assert found.columns == [*lf.columns, "matched"]
    got = sorted(((r.k, r.at and int((r.at - at(0)).total_seconds()), r.name, r.matched and r.matched.tie) for r in found.collect()), key=repr)
    assert got == plain_asof(left, right, direction, tolerance)


def test_asof_of_empty_tables(spark):
    one = spark.createDataFrame([("a", at(1))], "k string, at timestamp")
    assert [r.matched for r in t.asof_join(one, one.limit(0), "k", "at", "at").collect()] == [None]
    assert t.asof_join(one.limit(0), one, "k", "at", "at").count() == 0


def day(n):
    return None if n is None else dt.date(1999, 12, 1) + dt.timedelta(days=n)


def spans(rng, n):
    out = []
    for i in range(n):
        a = rng.randrange(-400, 400)
        out.append((rng.choice(["hot", "hot", "x", None]), i, a, a + rng.choice([0, 1, 5, 30, 300, -2])))
    return out + [("x", n, None, 4), ("y", n + 1, 1, 1), ("y", n + 2, 3, 3), ("z", n + 3, 1, 2), ("z", n + 4, 3, 4)]


@pytest.mark.parametrize("n", [3, 60])
def test_overlaps_and_gaps_equal_comparing_all(spark, n):
    rows = spans(random.Random(n), n)
    df = spark.createDataFrame([(k, i, day(a), day(b)) for k, i, a, b in rows], "holder string, id long, first date, last date")
    whole = [(k, i, a, b) for k, i, a, b in rows if k is not None and a is not None and a <= b]
    want = sorted(
        (k, i, j, day(max(a, c)), day(min(b, d)))
        for k, i, a, b in whole for m, j, c, d in whole if k == m and i < j and a <= d and c <= b
    )
    found = t.overlaps(df, "holder", "id", "first", "last")
    assert sorted(tuple(r) for r in found.collect()) == want
    holes = []
    for k in {r[0] for r in whole}:
        covered = {x for h, _, a, b in whole if h == k for x in range(a, b + 1)}
        free = [x for x in range(min(covered), max(covered)) if x not in covered]
        begins = [x for x in free if x - 1 not in free]
        holes += [(k, day(x), day(min(y for y in free if y >= x and y + 1 not in free))) for x in begins]
    assert sorted(tuple(r) for r in t.gaps(df, "holder", "first", "last").collect()) == sorted(holes)


def test_plans_meet_by_equality(spark):
    df = spark.createDataFrame([("a", 1, day(1), day(2))], "holder string, id long, first date, last date")
    text = t.overlaps(df, "holder", "id", "first", "last")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def plain_transfers(debits, credits, days):
    """The rounds of the docstring, by lists."""
    left, right, out = list(debits), list(credits), []
    for gap in [0, *(g for d in range(1, days + 1) for g in (d, -d))]:
        for group in sorted({(m, d + gap) for _, _, m, d in left}):
            shift = 0
            while True:
                own = sorted(r for r in left if (r[2], r[3] + gap) == group)
                other = sorted(r for r in right if (r[2], r[3]) == group)
                if not any(a[1] != b[1] for a in own for b in other):
                    break
                places = max(len(own), len(other))
                at_rank = {(i + shift) % places: r for i, r in enumerate(other)}
                for i, a in enumerate(own):
                    b = at_rank.get(i)
                    if b and a[1] != b[1]:
                        out.append((a[0], b[0], gap))
                        left.remove(a)
                        right.remove(b)
                shift += 1
    return out, left, right


def test_transfers_equal_plain_rounds(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("AAABCD"), rng.choice([5, 5, 5, 7, 9]), rng.randrange(8)) for i in range(60)]
    debits, credits = rows[:35], [(i - 30, *r) for i, *r in rows[35:]]
    schema = "id long, account string, amount long, day int"
    # all rounds of a group are counted from its first one, as here only if groups open together
    want, left, right = plain_transfers(debits, credits, 2)
    found = t.match_transfers(
        spark.createDataFrame(debits + [(99, None, 5, 1)], schema), spark.createDataFrame(credits, schema), days=2, block_rows=5
    ).collect()
    got = [tuple(r) for r in found]
    assert sorted(got) == sorted(want)
    assert len({d for d, _, _ in got}) == len({c for _, c, _ in got}) == len(got)
    for a in left:  # nothing that could be paired is left
        assert not any(a[1] != b[1] and a[2] == b[2] and abs(a[3] - b[3]) <= 2 for b in right)


def test_transfers_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, account string, amount long, day int")
    found = t.match_transfers(none, none, days=1)
    assert found.columns == ["debit_id", "credit_id", "gap"] and found.count() == 0
