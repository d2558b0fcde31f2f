"""Row-neighbour operators that never put one whole statement into one task.

A window over ``partitionBy(statement_id)`` sends a statement with a third of all rows to a
single task. The operators here cut every statement into *blocks* of neighbouring rows, run
the window inside a block, and carry what a block needs from the blocks before it through a
table with one row per block. The big table is shuffled once, on (key, block).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows of one statement that may share a task. Most statements are one block.
BLOCK_ROWS = 50_000
# Statements that can be split by quantiles at once; every other one has fewer than
# 1/HOT_KEYS of all rows.
HOT_KEYS = 1_000
HOT_SPLITS = 256


def block_of(position: Column, size: int) -> Column:
    """Block number of a dense position that starts at 1."""
    return F.floor((position - 1) / F.lit(size)).cast("long")


def _place(order: Sequence[str]) -> Column:
    # One plain column keeps max_by inside a hash aggregate; a struct would need a sort.
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    block: str = "block",
    sums: dict[str, Column] | None = None,
    latest: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    whole: dict[str, Column] | None = None,
    facts: DataFrame | None = None,
    only: Column | None = None,
    carry_over: bool = True,
) -> DataFrame:
    """Running values along ``order`` inside each key, computed block by block.

    ``block`` must be a column that grows along ``order``. ``sums`` are running totals up to
    and with the row; ``latest`` is the last non-null value up to and with the row; ``before``
    is the last non-null value of the rows before it; ``whole`` are totals of the whole key.
    ``facts`` (one row per key) are attached to every row through the block table.

    The per-block totals are partial aggregates (one row per block leaves each map task).
    Without ``whole`` and ``facts`` only keys with more than one block get a carry row; where
    the rows know that already (``only``), the others are not even read for it. Rows of keys
    that are all one block need no carry at all (``carry_over=False``): one window.
    """
    sums, latest, before, whole = sums or {}, latest or {}, before or {}, whole or {}
    lasts = {**latest, **before}
    place = _place(order)
    inside = Window.partitionBy(*keys, block).orderBy(*order)
    up_to_here = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until_before = inside.rowsBetween(Window.unboundedPreceding, -1)

    local = df.select(
        "*",
        *[F.sum(v).over(up_to_here).alias(f"_l_{n}") for n, v in sums.items()],
        *[F.last(v, ignorenulls=True).over(up_to_here).alias(f"_l_{n}") for n, v in latest.items()],
        *[F.last(v, ignorenulls=True).over(until_before).alias(f"_l_{n}") for n, v in before.items()],
    )
    if not carry_over:
        return local.select(
            *[F.col(f"`{c}`") for c in df.columns],
            *[F.coalesce(F.col(f"_l_{n}"), F.lit(0)).alias(n) for n in sums],
            *[F.col(f"_l_{n}").alias(n) for n in lasts],
        )
    totals = (df if only is None else df.where(only)).groupBy(*keys, block).agg(
        *[F.sum(v).alias(f"_t_{n}") for n, v in sums.items()],
        *[F.sum(v).alias(f"_w_{n}") for n, v in whole.items()],
        *[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_t_{n}") for n, v in lasts.items()],
        F.lit(1).alias("_one"),
    )
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(*keys)
    carry = totals.select(
        *keys,
        block,
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in sums],
        *[F.last(f"_t_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}") for n in lasts],
        *[F.sum(f"_w_{n}").over(everywhere).alias(n) for n in whole],
        F.count("_one").over(earlier).alias("_blocks_before"),
    )
    fact_names = []
    if facts is not None:
        fact_names = [c for c in facts.columns if c not in keys]
        carry = carry.join(facts, list(keys), "left")
    if not whole and facts is None:
        carry = carry.where("_blocks_before > 0")
    carry = carry.drop("_blocks_before")
    joined = local.join(carry, [*keys, block], "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[
            (F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n)
            for n in sums
        ],
        *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in lasts],
        *list(whole),
        *fact_names,
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    block: str = "block",
    name: str = "row_no",
) -> DataFrame:
    """Dense position 1..n of each row inside its key, without one task per key."""
    return scan(df, keys, order, block=block, sums={name: F.lit(1).cast("long")})


def with_previous(
    df: DataFrame, key: str, position: str, columns: Sequence[str], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``prev_<column>`` of the row before, for dense positions 1..n inside each key.

    The last row of a full block is sent to the next block as well, so one shuffle on
    (key, block) and one window do the work. The ``block`` column is kept: what follows can
    group or join on (key, block) without another shuffle.
    """
    home = block_of(F.col(position), block_rows)
    sent = df.withColumn(
        "block",
        F.explode(
            F.when(F.col(position) % block_rows == 0, F.array(home, home + 1)).otherwise(F.array(home))
        ),
    )
    w = Window.partitionBy(key, "block").orderBy(position)
    looked = sent.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])
    return looked.where(F.col("block") == home)


def hot_splits(df: DataFrame, key: str, order: Column, *, rows: int = BLOCK_ROWS) -> DataFrame:
    """Split points for keys that are too large for one task: (key, splits).

    At most HOT_KEYS keys come back, the largest ones first, so the result is bounded and safe
    to broadcast whatever the data. A key beyond that bound holds less than 1/HOT_KEYS of all
    rows and is handled as one block; the results are the same either way.
    """
    largest = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows)
        .orderBy(F.desc("_n"), key)
        .limit(HOT_KEYS)
        .select(key)
    )
    percents = [i / HOT_SPLITS for i in range(1, HOT_SPLITS)]
    return (
        df.join(F.broadcast(largest), key, "left_semi")
        .groupBy(key)
        .agg(F.array_distinct(F.percentile_approx(order, percents, F.lit(10_000))).alias("splits"))
    )


def block_by_splits(df: DataFrame, key: str, order: Column, splits: DataFrame) -> DataFrame:
    """Add ``block`` from the split points of ``hot_splits`` (0 for keys without any)."""
    joined = df.join(F.broadcast(splits), key, "left")
    below = F.size(F.filter("splits", lambda s: s < order))
    return joined.withColumn(
        "block", F.when(F.col("splits").isNull(), F.lit(0)).otherwise(below).cast("long")
    ).drop("splits")
