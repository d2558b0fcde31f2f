"""Queries that join along time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import temporal
from .inputs import entries, ledger, table
from .registry import iso, query

# Events are of one month and of few users: entries are moved into that month, accounts share users.
USERS, MONTH_DAYS = 150, 30
_POSTED = f"timestamp '2024-01-01' + to_days(cast(date_diff('day', date '1995-01-01', txn_date) % {MONTH_DAYS} as integer)) + to_seconds(txn_id * 37 % 86400)"


def posted(spark, sf_dir) -> DataFrame:
    """(txn_id, user_id, posted_at) of every ledger entry."""
    day = F.pmod(F.datediff("txn_date", F.lit("1995-01-01").cast("date")), F.lit(MONTH_DAYS))
    seconds = F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + day * 86400 + F.col("txn_id") * 37 % 86400
    return entries(spark, sf_dir).select(
        "txn_id", (F.col("statement_id") % USERS).alias("user_id"), F.timestamp_seconds(seconds).alias("posted_at")
    )


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")


@query(
    "asof_event",
    f"""with posted as (select o_orderkey as txn_id, o_custkey % {USERS} as user_id, {_POSTED} as posted_at
   from (select o_orderkey, o_custkey, cast(o_orderdate as date) as txn_date, o_orderkey as txn_id from orders))
   select txn_id, event_id, event_type from posted p asof left join events e on p.user_id = e.user_id and p.posted_at >= e.ts""",
    ledger=False,
)
def q_asof(spark, sf_dir):
    found = temporal.asof_join(posted(spark, sf_dir), _events(spark, sf_dir), "user_id", "posted_at", "ts", tie="event_id")
    return found.select("txn_id", "matched.event_id", "matched.event_type")


NEAR_S = 3600


@query(
    "nearest_event",
    f"""with posted as (select o_orderkey as txn_id, o_custkey % {USERS} as user_id, {_POSTED} as posted_at
   from (select o_orderkey, o_custkey, cast(o_orderdate as date) as txn_date, o_orderkey as txn_id from orders)),
   back as (select p.*, e.event_id as b_id, e.ts as b_ts from posted p asof left join events e on p.user_id = e.user_id and p.posted_at >= e.ts),
   both_ as (select p.*, e.event_id as f_id, e.ts as f_ts from back p asof left join events e on p.user_id = e.user_id and p.posted_at <= e.ts),
   near as (select txn_id, posted_at, case when b_ts is null or f_ts - posted_at < posted_at - b_ts then f_id else b_id end as event_id,
     case when b_ts is null or f_ts - posted_at < posted_at - b_ts then f_ts else b_ts end as matched_at from both_)
   select txn_id, case when abs(epoch_us(matched_at) - epoch_us(posted_at)) <= {NEAR_S}000000 then event_id end as event_id from near""",
    ledger=False,
)
def q_nearest(spark, sf_dir):
    found = temporal.asof_join(
        posted(spark, sf_dir), _events(spark, sf_dir), "user_id", "posted_at", "ts", tie="event_id", tolerance_s=NEAR_S, direction="nearest"
    )
    return found.select("txn_id", "matched.event_id")


# A holder has four accounts, a statement five entries.
ACCOUNTS, ENTRIES = 4, 5
_PERIODS = f"""periods as (select statement_id // {ACCOUNTS} as holder_id, statement_id * 100000 + (row_no - 1) // {ENTRIES} as period_id,
   min(txn_date) as first_day, max(txn_date) as last_day from ledger group by 1, 2)"""


def periods(spark, sf_dir) -> DataFrame:
    number = F.floor((F.col("row_no") - 1) / ENTRIES).cast("long")
    return (
        ledger(spark, sf_dir)
        .groupBy(
            F.floor(F.col("statement_id") / ACCOUNTS).cast("long").alias("holder_id"),
            (F.col("statement_id") * 100000 + number).alias("period_id"),
        )
        .agg(F.min("txn_date").alias("first_day"), F.max("txn_date").alias("last_day"))
    )


@query(
    "overlapping_statements",
    f"""with {_PERIODS} select a.holder_id, a.period_id as first_id, b.period_id as second_id,
   strftime(greatest(a.first_day, b.first_day), '%Y-%m-%d') as first_day, strftime(least(a.last_day, b.last_day), '%Y-%m-%d') as last_day
   from periods a join periods b on a.holder_id = b.holder_id and a.period_id < b.period_id and a.first_day <= b.last_day and b.first_day <= a.last_day""",
)
def q_overlaps(spark, sf_dir):
    found = temporal.overlaps(periods(spark, sf_dir), "holder_id", "period_id", "first_day", "last_day")
    return found.select("holder_id", "first_id", "second_id", iso("start").alias("first_day"), iso("end").alias("last_day"))


@query(
    "statement_gaps",
    f"""with {_PERIODS}, along as (select *, max(last_day) over (partition by holder_id order by first_day, last_day, period_id
     rows between unbounded preceding and 1 preceding) as covered from periods)
   select holder_id, strftime(covered + interval 1 day, '%Y-%m-%d') as first_day, strftime(first_day - interval 1 day, '%Y-%m-%d') as last_day
   from along where first_day > covered + interval 1 day""",
)
def q_gaps(spark, sf_dir):
    found = temporal.gaps(periods(spark, sf_dir), "holder_id", "first_day", "last_day")
    return found.select("holder_id", iso("start").alias("first_day"), iso("end").alias("last_day"))


# Amounts of orders are all but unique: transfers are of whole units.
UNIT = 5000


@query("matched_transfers")
def q_transfers(spark, sf_dir):
    """Debits and equal credits of another account within three days, each row used once; tested against plain code."""
    rows = entries(spark, sf_dir).select(
        F.col("txn_id").alias("id"),
        F.col("statement_id").alias("account"),
        F.floor((F.col("debit") + F.col("credit")) / UNIT).cast("long").alias("amount"),
        F.unix_date("txn_date").alias("day"),
        "type",
    )
    return temporal.match_transfers(rows.where("type = 'DEBIT'"), rows.where("type = 'CREDIT'"))
