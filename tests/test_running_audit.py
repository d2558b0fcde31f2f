import random
from decimal import Decimal

import pytest

from ledgerloom.operators import audit
from ledgerloom.streaming import running_audit as ra


def statement(rng, sid, n, newest_first):
    balance, rows = Decimal(500), []
    for i in range(n):
        debit, credit = (Decimal(rng.randrange(1, 9000)) / 100, Decimal(0))[:: rng.choice([1, -1])]
        balance += credit - debit
        rows.append([sid, 1000 * sid + i, balance + (25 if rng.random() < 0.1 else 0), debit, credit])
    if newest_first:
        rows.reverse()
    return [(s, t, i, b, d, c) for i, (s, t, b, d, c) in enumerate(rows, 1)]


SCHEMA = "statement_id long, txn_id long, row_no long, balance decimal(18,2), debit decimal(18,2), credit decimal(18,2)"


def test_any_order_settles_every_row_once():
    rng = random.Random(2)
    rows = statement(rng, 1, 60, False)
    want = {1: (False, False)}
    for a, b in zip(rows, rows[1:], strict=False):
        want[b[2]] = ra._fits([a[1], *map(str, a[3:])], [b[1], *map(str, b[3:])])
    for _ in range(30):
        ranges, got = ra.Ranges(), []
        some = rows + rng.choices(rows, k=20)
        rng.shuffle(some)
        for _, txn, row_no, *money in some:
            ranges = ra.Ranges(ranges.text())
            got += ranges.add(row_no, [txn, *map(str, money)], True)
        assert len(got) == 60 and {r: (f, v) for _, r, f, v in got} == want
        assert ranges.lows == [1] and ranges.by_low[1][1:3] == [60, None]


@pytest.mark.parametrize("block_rows", [4, 50_000])
def test_any_split_of_files_gives_the_audit(spark, tmp_path, block_rows):
    rng = random.Random(block_rows)
    rows = [r for sid in range(1, 9) for r in statement(rng, sid, [1, 2, 4, 5, 8, 9, 30, 41][sid - 1], sid % 3 == 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {(r.statement_id, r.row_no): r.balance_verified for r in audit.audit(df).collect()}
    landing, sink, log = (f"{tmp_path}/{n}" for n in ("landing", "sink", "log"))
    rng.shuffle(rows)
    parts = [rows[:30], rows[30:33], rows[:40], rows[40:], rows[5:50]]  # with repeated rows and files
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(landing)
        ra.settle_stream(spark, landing, sink, log, schema=df.schema, block_rows=block_rows)
    got = ra.verdicts(spark, sink).collect()
    assert len(got) == len(want) and {(r.statement_id, r.row_no): r.balance_verified for r in got} == want
