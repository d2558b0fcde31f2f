"""Session defaults and the folder for tables that cut a long plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and local runs; on a cluster use the cluster's own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgerloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # few bytes, much work per row: keep all local cores busy
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Only a local session that sets none gets a temporary folder. On a cluster the executors
    would each write to their own disk there, so a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        folder = _own_folders[app]
    return folder.rstrip("/")


# Spark's own switch: what a query shuffled is deleted as it ends, not when the driver next collects garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Tables staged within the ``make`` of ``settle``.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a later step reads the same rows more than once: the plan is cut, lost
    executors read the files again, and later scans prune columns. What was shuffled for it
    is deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_path = path
    if (made := _made.get()) is not None:
        made.append(staged)
    return staged


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """Stage what ``make`` returns; what was staged on the way there is deleted after that."""
    token = _made.set(made := [])
    try:
        df = make()
    finally:
        _made.reset(token)
    settled = stage(df, name)
    for spent in made:
        unstage(spent)
    return settled


def unstage(staged: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing will read it again."""
    spark, path = staged.sparkSession, staged._staged_path
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
