"""Joins along time: the last row before another, overlapping periods, and one-to-one transfers.

No join here compares all rows of a key. As-of joins carry values along the time axis in blocks,
overlaps meet in bins of time, transfers are matched rank by rank inside (amount, day).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage, unstage
from .blocks import BLOCK_ROWS, block_by_splits, hot_splits, number_rows, scan

DIRECTIONS = ("backward", "forward", "nearest")


def _micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _carried(rows: DataFrame, others: DataFrame, sign: int, block_rows: int) -> DataFrame:
    """``rows`` (_key, _at, _row) with _found, the last of ``others`` (_key, _at, _tie, _other) up to them.

    ``sign`` -1 runs time backwards, so that the last one is the next one. Both tables are merged
    along time and the value is carried from row to row inside a block and from block to block;
    large keys are cut at quantiles of time, equal times stay in one block.
    """
    empty = F.lit(None)
    other = others.schema["_other"].dataType
    row = rows.schema["_row"].dataType
    merged = others.select(
        "_key", (F.col("_at") * sign).alias("_at"), F.lit(0).alias("_side"), "_tie", "_other", empty.cast(row).alias("_row")
    ).unionByName(
        rows.select(
            "_key", (F.col("_at") * sign).alias("_at"), F.lit(1).alias("_side"), empty.cast("long").alias("_tie"),
            empty.cast(other).alias("_other"), "_row",
        )
    )
    merged = stage(merged, "merged")
    cut = hot_splits(merged.select("_key", "_at"), "_key", F.col("_at"), rows=block_rows)
    placed = block_by_splits(merged, "_key", F.col("_at"), cut)
    held = F.when(F.col("_side") == 0, F.struct(F.col("_at").alias("at"), F.col("_other").alias("other")))
    found = scan(placed, ["_key"], ["_at", "_side", "_tie"], latest={"_found": held}).where("_side = 1")
    return found.select("_key", (F.col("_at") * sign).alias("_at"), "_row", "_found")


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_at: str,
    right_at: str,
    *,
    tie: str | None = None,
    tolerance_s: float | None = None,
    direction: str = "backward",
    name: str = "matched",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every row of ``left`` with the one row of ``right`` of its key that is nearest in time.

    ``backward`` takes the last row at or before the left row's time, ``forward`` the first at or
    after it, ``nearest`` the closer of both (the earlier on equal distance). Of right rows at the
    same time the one with the greatest ``tie``, a long, counts. The match is the struct ``name``
    of all right columns, null if there is none within ``tolerance_s`` seconds. Left rows without
    key or time match nothing, such right rows are left out; repeated left rows stay.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    columns = left.columns
    rows = left.select(F.col(key).alias("_key"), _micros(F.col(left_at)).alias("_at"), F.struct(*columns).alias("_row"))
    order = F.col(tie).cast("long") if tie else F.lit(0).cast("long")
    others = right.select(
        F.col(key).alias("_key"), _micros(F.col(right_at)).alias("_at"), order.alias("_tie"), F.struct(*right.columns).alias("_other")
    ).where("_key is not null and _at is not null")
    whole = F.col("_key").isNotNull() & F.col("_at").isNotNull()
    placed = rows.where(whole)
    if direction == "nearest":
        before = _carried(placed, others, 1, block_rows)
        packed = before.select("_key", "_at", F.struct("_row", "_found").alias("_row"))
        both = _carried(packed, others, -1, block_rows)
        earlier, later = F.col("_row._found"), F.col("_found")
        later_is_nearer = earlier["at"].isNull() | (-later["at"] - F.col("_at") < F.col("_at") - earlier["at"])
        found = both.select(
            "_at",
            F.col("_row._row").alias("_row"),
            F.when(later.isNotNull() & later_is_nearer, F.struct((-later["at"]).alias("at"), later["other"].alias("other")))
            .otherwise(earlier)
            .alias("_found"),
        )
    else:
        sign = 1 if direction == "backward" else -1
        carried = _carried(placed, others, sign, block_rows)
        found = carried.select(
            "_at", "_row", F.when(F.col("_found").isNotNull(), F.struct((F.col("_found.at") * sign).alias("at"), F.col("_found.other").alias("other"))).alias("_found")
        )
    near = F.lit(True) if tolerance_s is None else F.abs(F.col("_at") - F.col("_found.at")) <= int(tolerance_s * 1_000_000)
    matched = found.select("_row", F.when(near, F.col("_found.other")).alias("_matched"))
    none = rows.where(~whole).select("_row", F.lit(None).cast(others.schema["_other"].dataType).alias("_matched"))
    return matched.unionByName(none).select("_row.*", F.col("_matched").alias(name))


def _binned(intervals: DataFrame, width: int) -> DataFrame:
    bins = F.sequence(F.floor(F.col("_from") / width), F.floor(F.col("_to") / width))
    return intervals.withColumn("_bin", F.explode(bins))


def _days(intervals: DataFrame, key: str, start: str, end: str, *more: str) -> DataFrame:
    """(_key, _from, _to, ...) in days, both included; rows with a null or an end before the start are left out."""
    days = intervals.select(
        F.col(key).alias("_key"), F.unix_date(F.col(start).cast("date")).alias("_from"), F.unix_date(F.col(end).cast("date")).alias("_to"), *more
    )
    return days.where("_key is not null and _from <= _to")


def _width(days: DataFrame) -> int:
    """Bins as wide as a period is long on average: so each falls into about two."""
    length = days.agg(F.avg(F.col("_to") - F.col("_from") + 1)).first()[0]
    return max(1, round(length or 1))


def overlaps(intervals: DataFrame, key: str, ident: str, start: str, end: str) -> DataFrame:
    """(key, first_id, second_id, start, end): pairs of periods of one key that share days.

    first_id < second_id; start and end are the shared days. Periods are copied to the bins of
    time they touch and meet there; a pair counts in the first bin that both touch, so once.
    """
    days = _days(intervals, key, start, end, F.col(ident).alias("_id"))
    width = _width(days)
    binned = stage(_binned(days, width), "bins")
    a = binned.select("_key", "_bin", *[F.col(f"_{c}").alias(f"a_{c}") for c in ("id", "from", "to")])
    b = binned.select("_key", "_bin", *[F.col(f"_{c}").alias(f"b_{c}") for c in ("id", "from", "to")])
    begin, stop = F.greatest("a_from", "b_from"), F.least("a_to", "b_to")
    met = a.join(b, ["_key", "_bin"]).where(
        (F.col("a_id") < F.col("b_id")) & (begin <= stop) & (F.col("_bin") == F.floor(begin / width))
    )
    return met.select(
        F.col("_key").alias(key),
        F.col("a_id").alias("first_id"),
        F.col("b_id").alias("second_id"),
        F.date_from_unix_date(begin).alias("start"),
        F.date_from_unix_date(stop).alias("end"),
    )


def gaps(intervals: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): days between the first and the last period of a key that none covers."""
    days = stage(_days(intervals, key, start, end), "periods")
    width = _width(days)
    after = days.select("_key", (F.col("_to") + 1).alias("_day")).distinct().withColumn("_bin", F.floor(F.col("_day") / width))
    binned = _binned(days, width)
    inside = [
        after["_key"] == binned["_key"], after["_bin"] == binned["_bin"],
        binned["_from"] <= after["_day"], after["_day"] <= binned["_to"],
    ]
    open_ = after.join(binned, inside, "left_anti").select("_key", F.date_from_unix_date("_day").alias("start"))
    starts = days.select("_key", F.date_from_unix_date("_from").alias("begin")).distinct()
    ahead = asof_join(open_, starts, "_key", "start", "begin", direction="forward", name="next")
    return ahead.where("next is not null").select(
        F.col("_key").alias(key), "start", F.date_sub(F.col("next.begin"), 1).alias("end")
    )


def _ranked(rows: DataFrame, block_rows: int) -> DataFrame:
    """``rows`` with rank, from 1 by id inside (amount, day), and n, the rows there."""
    group = F.concat_ws("/", "amount", "day")
    keyed = rows.withColumn("_group", group)
    cut = hot_splits(keyed.select("_group", "id"), "_group", F.col("id"), rows=block_rows)
    ranked = number_rows(block_by_splits(keyed, "_group", F.col("id"), cut), ["_group"], ["id"], name="rank")
    return ranked.drop("_group", "block")


def match_transfers(debits: DataFrame, credits: DataFrame, *, days: int = 3, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(debit_id, credit_id, gap): each debit with at most one equal credit of another account, and the reverse.

    Both tables are (id, account, amount, day), ``day`` a number of days, ids unique in a table;
    rows with a null are left out. ``gap`` is the credit's day less the debit's. Gaps are tried in
    the order 0, 1, -1, 2, -2 ... up to ``days``; for each, debits and credits of an amount and day
    are paired by their ranks of id, in rounds that shift the credits' ranks by one more, until no
    two rows of different accounts are left that could be paired. So only pairs of equal rank
    are ever made, however many rows share an amount and a day.
    """
    whole = "id is not null and account is not null and amount is not null and day is not null"
    left = stage(debits.select("id", "account", "amount", "day").where(whole), "debits")
    right = stage(credits.select("id", "account", "amount", "day").where(whole), "credits")
    found = None
    for gap in [0, *(g for d in range(1, days + 1) for g in (d, -d))]:
        shift = 0
        while True:
            seen = [F.min("account").alias("low"), F.max("account").alias("high"), F.count(F.lit(1)).alias("n")]
            meets = left.withColumn("day", F.col("day") + gap).groupBy("amount", "day").agg(*seen)
            theirs = right.groupBy("amount", "day").agg(*[c.alias(f"c_{n}") for c, n in zip(seen, ("low", "high", "n"), strict=True)])
            some = "low <> high or c_low <> c_high or low <> c_low"
            open_ = stage(
                meets.join(theirs, ["amount", "day"]).where(some).select("amount", "day", F.greatest("n", "c_n").alias("places")), "open"
            )
            if open_.isEmpty():
                unstage(open_)
                break
            own = _ranked(left.withColumn("day", F.col("day") + gap).join(open_, ["amount", "day"]), block_rows)
            other = _ranked(right.join(open_, ["amount", "day"]), block_rows)
            turned = other.select(
                "amount", "day", F.col("id").alias("credit_id"), F.col("account").alias("c_account"),
                (F.pmod(F.col("rank") - 1 + shift, F.col("places")) + 1).alias("rank"),
            )
            pairs = own.join(turned, ["amount", "day", "rank"]).where("account <> c_account")
            pairs = stage(pairs.select(F.col("id").alias("debit_id"), "credit_id", F.lit(gap).alias("gap")), "pairs")
            found = pairs if found is None else found.unionByName(pairs)
            before = left, right, open_
            left = stage(left.join(pairs.select(F.col("debit_id").alias("id")), "id", "left_anti"), "debits")
            right = stage(right.join(pairs.select(F.col("credit_id").alias("id")), "id", "left_anti"), "credits")
            for table in before:
                unstage(table)
            shift += 1
    if found is None:
        ids = [left.select(F.col("id").alias("debit_id")).schema[0], right.select(F.col("id").alias("credit_id")).schema[0]]
        return left.limit(0).select(F.col("id").cast(ids[0].dataType).alias("debit_id"), F.col("id").cast(ids[1].dataType).alias("credit_id"), F.lit(0).alias("gap"))
    return found
