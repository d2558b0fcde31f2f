"""Queries over streams by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from ..streaming import event_time, running_audit
from .book_queries import AUDIT_STEPS
from .inputs import ledger, table
from .io_queries import fresh_folder
from .registry import query

# Windows of a day, rows may come two days late; every fiftieth event comes with the last delivery.
WINDOW_S, DELAY_S = 86_400, 172_800
_FIRST, _SECOND = 12, 22
_DELIVERY = f"case when event_id % 50 = 0 then 3 when day(ts) <= {_FIRST} then 1 when day(ts) <= {_SECOND} then 2 else 3 end"
_DEALT = f"""dealt as (select *, {_DELIVERY} as delivery, cast(floor(epoch(ts)) as bigint) // {WINDOW_S} * {WINDOW_S} as opened from events),
 marks as (select d.delivery, (select max(epoch(ts)) from dealt e where e.delivery < d.delivery) as latest from (select distinct delivery from dealt) d),
 told as (select d.*, coalesce(opened + {WINDOW_S} <= floor(latest) - {DELAY_S}, false) as late from dealt d join marks using (delivery))"""


def _deliveries(spark, sf_dir) -> list[DataFrame]:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    dealt = events.withColumn("delivery", F.expr(_DELIVERY))
    return [dealt.where(F.col("delivery") == n).drop("delivery") for n in (1, 2, 3)]


def _drained(spark, sf_dir) -> event_time.Folders:
    folders = event_time.Folders(fresh_folder(spark, "stream"))
    for rows in _deliveries(spark, sf_dir):
        rows.write.mode("append").parquet(folders.landing)
        event_time.drain(
            spark, folders.landing, folders, schema=rows.schema, at="ts", window_s=WINDOW_S, delay_s=DELAY_S, keys=["event_type"],
            totals={"events": lambda: F.count(F.lit(1)), "value": lambda: F.sum(F.col("value").cast("decimal(18,2)"))},
        )
    return folders


@query(
    "stream_windows",
    f"""with {_DEALT}, ended as (select floor(max(epoch(ts))) - {DELAY_S} as mark from told where not late)
   select cast(opened as bigint) as window_start, event_type, count(*) as events, cast(sum(cast(value as decimal(18,2))) as double) as value
   from told, ended where not late and opened + {WINDOW_S} <= mark group by 1, 2""",
    ledger=False,
)
def q_windows(spark, sf_dir):
    closed = spark.read.parquet(_drained(spark, sf_dir).windows)
    return closed.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "events", F.col("value").cast("double").alias("value"))


@query("stream_late_rows", f"with {_DEALT} select event_id, event_type, value from told where late", ledger=False)
def q_late(spark, sf_dir):
    return spark.read.parquet(_drained(spark, sf_dir).late).select("event_id", "event_type", "value")


@query("stream_redelivery", "select event_id, event_type, value from events", ledger=False)
def q_redelivery(spark, sf_dir):
    """Every delivery lands twice, the second time together with the next one."""
    folders = event_time.Folders(fresh_folder(spark, "stream"))
    before = None
    for rows in _in_order(spark, sf_dir):
        for landed in (rows, before):
            if landed is not None:
                landed.write.mode("append").parquet(folders.landing)
        event_time.ingest_once(spark, folders.landing, folders, schema=rows.schema, at="ts", delay_s=DELAY_S)
        before = rows
    return spark.read.parquet(folders.rows).select("event_id", "event_type", "value")


def _in_order(spark, sf_dir) -> list[DataFrame]:
    """Three deliveries in the order of time."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    return [events.where(day <= _FIRST), events.where((day > _FIRST) & (day <= _SECOND)), events.where(day > _SECOND)]


@query(
    "stream_audit",
    f"with {AUDIT_STEPS} select statement_id, txn_id, cast(row_no as bigint) as row_no, balance_verified from audited",
)
def q_stream_audit(spark, sf_dir):
    """The rows of every statement come in three deliveries, dealt by transaction, the second one twice."""
    landing, sink, log = (fresh_folder(spark, n) for n in ("landing", "sink", "progress"))
    rows = ledger(spark, sf_dir).select("statement_id", "txn_id", "row_no", "balance", "debit", "credit")
    rows = stage(rows, "audited-rows")  # read once for each delivery
    for part in (0, 1, 1, 2):
        rows.where(F.pmod(F.xxhash64("txn_id"), F.lit(3)) == part).write.mode("append").parquet(landing)
        running_audit.settle_stream(spark, landing, sink, log, schema=rows.schema)
    return running_audit.verdicts(spark, sink).select("statement_id", "txn_id", "row_no", "balance_verified")
