"""All registered queries."""

from __future__ import annotations

from . import book_queries, change_queries, header_queries, io_queries, line_queries, model_queries, sketch_queries, stream_queries, table_queries, time_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
