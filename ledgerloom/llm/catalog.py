"""Queries of the training-data operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import queries_index, queries_text, queries_web

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**queries_web.QUERIES, **queries_text.QUERIES, **queries_index.QUERIES}
ORACLES: dict[str, str] = {**queries_web.ORACLES, **queries_text.ORACLES, **queries_index.ORACLES}
