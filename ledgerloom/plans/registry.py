"""The list of registered queries, each with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import LEDGER_SQL

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *, ledger: bool = True):
    """Register a query; ``sql`` may use the ledger CTE unless ``ledger=False``."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            body = sql.strip()
            if ledger:
                joiner = ",\n" if body.startswith("with ") else "\n"
                body = f"with {LEDGER_SQL}{joiner}{body.removeprefix('with ')}"
            ORACLES[name] = body
        return fn

    return register


def amount(c: Column | str) -> Column:
    """Money for a result: both engines agree on a double with two decimals."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 2).cast("double")


def iso(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def share(part: Column, total: Column) -> Column:
    """Percentage to one decimal; a zero total counts as 1."""
    base = F.when(total == 0, F.lit(1.0)).otherwise(total.cast("double"))
    return F.round(part.cast("double") * 100 / base, 1)
