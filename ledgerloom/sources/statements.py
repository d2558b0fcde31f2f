"""Readers of statement inputs: one job over all files of a folder or glob."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "statement_id string, page_no long, text string"
TABLES = "statement_id string, table_no long, row_no long, cells array<string>"
WORD_BOXES = "statement_id string, page_no long, text string, x double, y double, h double, score string"


FILE_NAME = r"([^/]+?)(\.[^./]*)?$"


def statement_id(pattern: str = FILE_NAME) -> Column:
    """Id of the statement a row comes from: base name of its file, or another part of its path."""
    return F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)


def read_files(
    spark: SparkSession, path: str, fmt: str, schema: str | None = None, *, id_pattern: str = FILE_NAME, **options
) -> DataFrame:
    """Rows of all files below ``path`` with ``statement_id`` taken from the path.

    ``pathGlobFilter`` and other reader options may be given; a malformed record fails.
    """
    reader = spark.read.format(fmt).options(**options)
    if fmt in ("json", "csv"):
        reader = reader.option("mode", "FAILFAST")
    if schema:
        reader = reader.schema(schema)
    return reader.load(path).withColumn("statement_id", statement_id(id_pattern))


def read_text_statements(spark: SparkSession, path: str, **options) -> DataFrame:
    """One text file per statement; a form feed starts a new page."""
    whole = read_files(spark, path, "text", wholetext=True, **options)
    return whole.select(
        "statement_id", F.posexplode(F.split("value", "\f")).alias("at", "text")
    ).select("statement_id", (F.col("at") + 1).cast("long").alias("page_no"), "text")


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(PAGES).load(path)


def read_tables(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(TABLES).load(path)


def read_word_boxes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(WORD_BOXES).load(path)


def read_ledger_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Ledger rows as JSON lines; a malformed row fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
