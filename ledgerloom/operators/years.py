"""The year a statement (or one of its tables) speaks of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import (
    FIRST_YEAR, LAST_YEAR, LONG_MONTHS, YEAR_HEAD_CHARS, YEAR_PATTERNS, YEAR_TOKEN, YEAR_WORDS, modal_year, stated_year,
    year_tokens,
)
from ..functions.text import let
from ..session import stage
from .blocks import BLOCK_ROWS, block_of, number_rows, scan

# The pattern that lets any text of its line stand between its keyword and the year.
PERIOD = 2
# The other patterns take at most seven words, so six filled rows above the one they end in.
WORDS, ROWS_ABOVE = 7, 6
_DAY = r"\s*(?:\d{1,2},?)?"
# Ends of a row that a year pattern may go on from in the rows below.
UNFINISHED = (
    r"(?i)(?:(?:Statement(?:\s*(?:Date|as(?:\s*of)?))?|Date(?:\s*of(?:\s*Statement)?)?)\s*[:\-]?\s*"
    rf"(?:[A-Za-z]+{_DAY})?|(?:Ending|Beginning)(?:\s*Balance(?:\s*on(?:\s*[A-Za-z]+{_DAY})?)?)?"
    rf"|\b(?:{'|'.join(LONG_MONTHS)}){_DAY})\s*$"
)
OPEN_PERIOD = r"(?i)Period(?![^\n]*\b(?:19|20)\d\d\b)[^\n]*\z"
HITS = [f"_y{i}" for i in range(len(YEAR_PATTERNS))]


def first_hits(text: Column, order: Column) -> list[Column]:
    """Aggregates: per year pattern, what its first match in text order says.

    The year is kept as 0 where the first match lies outside the accepted years, because a
    later match of the same pattern must not replace it.
    """
    out = []
    for i, (pattern, _) in enumerate(YEAR_PATTERNS):
        matched = text.rlike(r"(19|20)\d\d") & text.rlike(YEAR_WORDS[i]) & text.rlike(pattern)
        year = F.when(matched, F.coalesce(stated_year(text, i), F.lit(0)))
        out.append(F.min_by(year, F.when(matched, order)).alias(f"_y{i}"))
    return out


def chosen_year(head_text: Column) -> Column:
    """The first pattern that gave a year, else the most frequent year of the head text."""
    stated = [F.nullif(F.col(f"_y{i}"), F.lit(0)) for i in range(len(YEAR_PATTERNS))]
    return F.coalesce(*stated, modal_year(year_tokens(F.substring(head_text, 1, YEAR_HEAD_CHARS))))


def joined_head(text: Column, order: Column, rank: Column, chars: int, separator: str) -> Column:
    """Aggregate: the first ``chars`` characters of ordered texts.

    Every text adds at least its separator, so only the first ``chars`` texts (by ``rank``,
    counted from 1) can matter; nothing beyond them is collected.
    """
    piece = F.when(rank <= chars + 1, F.struct(order.alias("o"), F.substring(text, 1, chars).alias("t")))
    ordered = F.array_sort(F.collect_list(piece))
    return F.substring(F.array_join(F.transform(ordered, lambda p: p["t"]), separator), 1, chars)


def row_words(cells: Column) -> Column:
    return F.array_join(cells, " ", "")


def goes_on(text: Column) -> Column:
    """Whether a year pattern may begin in a row and end in a later one."""
    return F.coalesce(text.rlike(OPEN_PERIOD) | text.rlike(UNFINISHED), F.lit(False))


def hits_over_rows(rows: DataFrame, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``first_hits`` of tables as if their rows were one text, row after row.

    Blank rows do not matter. Each row is searched together with the last words of the rows
    above it; rows at the end of a block are sent to the next block too. A period still
    without its year is carried from row to row until a year or the end of the line.
    """
    keys, size = list(keys), max(block_rows, ROWS_ABOVE)
    text = F.col("_text")
    filled = rows.select(*keys, "row_no", row_words(F.col("cells")).alias("_text")).where(text.rlike(r"\S"))
    filled = filled.withColumn("block", block_of(F.col("row_no"), size))
    numbered = number_rows(filled, keys, ["row_no"], name="_at").withColumn("block", block_of(F.col("_at"), size))

    first_line = F.substring_index(text, "\n", 1)
    year = F.regexp_extract(first_line, YEAR_TOKEN, 1)
    ends = year.rlike(r"\d") | text.contains("\n")
    state = F.when(text.rlike(OPEN_PERIOD), F.lit(1)).when(ends, F.lit(0))
    carried = scan(numbered, keys, ["_at"], before={"_open": state})
    closed = carried.where((F.col("_open") == 1) & year.rlike(r"\d"))
    year = F.nullif(year, F.lit("")).cast("int")
    late = closed.groupBy(*keys).agg(
        F.min("_at").alias("_late_at"),
        F.min_by(F.when(year.between(FIRST_YEAR, LAST_YEAR), year).otherwise(0), "_at").alias("_late"),
    )

    home = F.col("block")
    border = F.col("_at") > (home + 1) * size - ROWS_ABOVE
    near = numbered.withColumn("_in", F.explode(F.when(border, F.array(home, home + 1)).otherwise(F.array(home))))
    above = Window.partitionBy(*keys, "_in").orderBy("_at").rowsBetween(-ROWS_ABOVE, -1)
    # a bar stands for words left out: what is above them does not go on below
    cut = let(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""),
        lambda words: F.when(F.size(words) <= WORDS, F.array_join(words, " ")).otherwise(
            F.concat(F.lit("| "), F.array_join(F.slice(words, -WORDS, WORDS), " "))
        ),
    )
    joined = near.withColumn("_above", F.array_join(F.collect_list(cut).over(above), " ")).where("_in = block")
    whole = F.concat_ws(" ", F.nullif(F.col("_above"), F.lit("")), text)
    over_rows, in_row = first_hits(whole, F.col("_at")), first_hits(text, F.col("_at"))
    own_at = F.min(F.when(text.rlike(YEAR_PATTERNS[PERIOD][0]), F.col("_at"))).alias("_own_at")
    hits = joined.groupBy(*keys).agg(
        *[in_row[i] if i == PERIOD else over_rows[i] for i in range(len(HITS))], own_at
    )
    # a period named in a row above the one that ends it comes before those the row names itself
    is_late = F.col("_late_at").isNotNull() & (F.col("_late_at") <= F.coalesce("_own_at", "_late_at"))
    stated = [F.when(is_late, F.col("_late")).otherwise(F.col(c)) if i == PERIOD else F.col(c) for i, c in enumerate(HITS)]
    return hits.join(late, keys, "left").select(*keys, *[c.alias(n) for c, n in zip(stated, HITS, strict=True)])


def table_years(rows: DataFrame, hits: DataFrame, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Year context per table from its rows and the ``first_hits`` over them.

    Tables in which a pattern may run on from a row to the next (``_goes_on``) are read again
    over their rows; where there are none, nothing is. The head text is collected for tables
    that state no year by a pattern only.
    """
    keys = list(keys)
    running = hits.where("_goes_on").select(*keys)
    if not running.isEmpty():
        over_rows = stage(hits_over_rows(rows.join(running, keys, "left_semi"), keys, block_rows=block_rows), "years-over-rows")
        hits = hits.where("NOT _goes_on").select(*keys, *HITS).unionByName(over_rows)
    found = F.coalesce(*[F.nullif(F.col(f"_y{i}"), F.lit(0)) for i in range(len(YEAR_PATTERNS))])
    resolved = hits.select(*keys, found.alias("statement_year"))
    unresolved = resolved.where(F.col("statement_year").isNull()).select(*keys)
    heads = (
        rows.where(F.col("row_no") <= YEAR_HEAD_CHARS + 1)
        .join(unresolved, list(keys), "left_semi")
        .groupBy(*keys)
        .agg(
            joined_head(row_words(F.col("cells")), F.col("row_no"), F.col("row_no"), YEAR_HEAD_CHARS, " ").alias("_head")
        )
        .select(*keys, modal_year(year_tokens(F.col("_head"))).alias("_modal"))
    )
    return resolved.join(heads, list(keys), "left").select(
        *keys, F.coalesce("statement_year", "_modal").alias("statement_year")
    )
