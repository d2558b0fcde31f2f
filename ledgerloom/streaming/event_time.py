"""Streams by event time: windows that close, rows that come too late, files that come twice."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Folders:
    """Where a stream keeps its progress and its results, below one shared folder."""

    base: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.base}/{name}"


def _source(spark: SparkSession, landing: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(landing)


def split_late(
    spark: SparkSession, landing: str, folders: Folders, *, schema, at: str, window_s: int, delay_s: int
) -> None:
    """Deal the new files of ``landing`` to the folders ``timely`` and ``late``, until it is drained.

    A row is late if its window had ended ``delay_s`` before the latest time seen in earlier
    batches, or if it has no time. Each micro-batch writes its own ``batch_id`` folders and the
    latest time it has seen, replacing what an interrupted attempt left there, so that every row
    is dealt once whatever fails.
    """
    seen = spark.createDataFrame([], "batch_id long, latest long")

    def deal(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        progress = session.read.schema(seen.schema).parquet(folders.seen) if batch_id else seen
        latest = progress.where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        seconds = F.unix_seconds(F.col(at).cast("timestamp"))
        closes = F.floor(seconds / window_s) * window_s + window_s
        late = seconds.isNull() if latest is None else seconds.isNull() | (closes <= latest - delay_s)
        batch.where(~late).write.mode("overwrite").parquet(f"{folders.timely}/batch_id={batch_id}")
        batch.where(late).write.mode("overwrite").parquet(f"{folders.late}/batch_id={batch_id}")
        newest = batch.where(~late).agg(F.max(seconds).alias("latest"))
        newest.coalesce(1).write.mode("overwrite").parquet(f"{folders.seen}/batch_id={batch_id}")

    running = (
        _source(spark, landing, schema)
        .writeStream.foreachBatch(deal)
        .option("checkpointLocation", folders.deal_log)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def close_windows(
    spark: SparkSession,
    folders: Folders,
    *,
    schema,
    at: str,
    window_s: int,
    delay_s: int,
    keys: Sequence[str],
    totals: dict[str, Callable[[], Column]],
) -> None:
    """Append the totals of every window that has closed to the folder ``windows``.

    A window (start, by epoch) and its keys come out once, when the latest timely row is
    ``delay_s`` past its end. State holds open windows only. What ``split_late`` let through is
    never too late here: its own watermark is at least as far.
    """
    span = F.window(F.col("_at"), f"{window_s} seconds")
    counted = (
        _source(spark, folders.timely, schema)
        .withColumn("_at", F.col(at).cast("timestamp"))
        .withWatermark("_at", f"{delay_s} seconds")
        .groupBy(span.alias("span"), *keys)
        .agg(*[made().alias(name) for name, made in totals.items()])
        .select(F.col("span.start").alias("window_start"), *keys, *totals)
    )
    running = (
        counted.writeStream.outputMode("append")
        .format("parquet")
        .option("path", folders.windows)
        .option("checkpointLocation", folders.window_log)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()


def drain(spark: SparkSession, landing: str, folders: Folders, *, schema, at: str, window_s: int, delay_s: int, keys, totals) -> None:
    """All that has landed: late rows aside, closed windows appended. Call again after each delivery."""
    split_late(spark, landing, folders, schema=schema, at=at, window_s=window_s, delay_s=delay_s)
    close_windows(spark, folders, schema=schema, at=at, window_s=window_s, delay_s=delay_s, keys=keys, totals=totals)


def ingest_once(spark: SparkSession, landing: str, folders: Folders, *, schema, at: str, delay_s: int) -> list[dict]:
    """Append the new rows of ``landing`` to the folder ``rows``, each content once; returns the state's progress.

    Rows are known by a hash of all their columns. A hash is kept until ``delay_s`` after the row's
    own time has passed, which bounds the state by the rows of that span; a file that comes again
    within it, in the same batch or in a later one, adds nothing. Rows that are older than that
    when they come count as delivered before.
    """
    names = schema.fieldNames()
    content = F.sha2(F.to_json(F.struct(*names)), 256)
    once = (
        _source(spark, landing, schema)
        .withColumn("_at", F.col(at).cast("timestamp"))
        .withColumn("_content", content)
        .withWatermark("_at", f"{delay_s} seconds")
        .dropDuplicatesWithinWatermark(["_content"])
        .select(*names)
    )
    running = (
        once.writeStream.outputMode("append")
        .format("parquet")
        .option("path", folders.rows)
        .option("checkpointLocation", folders.row_log)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return [s for progress in running.recentProgress for s in progress["stateOperators"]]
