"""Incremental ingestion of a landing folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest_stream(
    spark: SparkSession,
    landing: str,
    sink: str,
    checkpoint: str,
    *,
    schema: str,
    process: Callable[[DataFrame], DataFrame],
    fmt: str = "parquet",
    suffix: str | None = None,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run ``process`` over every new file of ``landing`` and append the result to ``sink``.

    ``suffix`` accepts file names in any letter case and ignores other files. Each micro-batch
    is the ordinary batch job, and writes its own ``batch_id`` folder, replacing what an
    interrupted attempt left there: a file counts once whatever fails. The query stops when
    the folder is drained; call it again (or on a schedule) for later files. A statement must
    arrive whole: its rows may not be spread over files of different batches when ``process``
    looks across rows.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if suffix:
        letters = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
        reader = reader.option("pathGlobFilter", f"*{letters}")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return (
        reader.load(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
