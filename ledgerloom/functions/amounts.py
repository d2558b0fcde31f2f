"""Money text to DECIMAL(18,2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"

# Cell texts that mean "no amount".
EMPTY_AMOUNTS = ["", "-", "--", "NA", "N/A", "Nil", "nil", "0"]


def money(value) -> Column:
    return F.lit(value).cast(MONEY)


def read_money(c: Column) -> Column:
    """A plain number as money; one that does not fit MONEY is unreadable and counts as 0.

    Null stays null. Any other unreadable text counts as 0 too, as in ``clean_amount``.
    """
    return F.when(c.isNotNull(), F.coalesce(c.try_cast(MONEY), money(0)))


def clean_amount(c: str, *, read_rs_prefix: bool = False) -> Column:
    """Signed amount of a money text column; 0 when there is none.

    Handles currency signs, thousands groups (western, Indian and European), accounting
    parentheses, minus signs and a trailing ``Dr``. ``Rs.`` leaves a stray dot, which makes
    the text unreadable (0); ``read_rs_prefix=True`` reads it instead.
    """
    text = rf"regexp_replace(coalesce({c}, ''), r'(?U)^\s+|\s+$', '')"
    if read_rs_prefix:
        text = rf"regexp_replace({text}, r'(?i)\brs\.?\s*(?=[\d(+\-.])', '')"
    empty = ", ".join(f"'{t}'" for t in EMPTY_AMOUNTS)
    european = r"b rlike r'^(\d{1,3}(\.\d{3})+|\d+),\d{2}$'"
    digits = rf"regexp_replace(CASE WHEN {european} THEN translate(b, ',.', '.') ELSE translate(b, ',', '') END, r'[^\d.]', '')"
    negative = r"t rlike r'^\(.*\)$' OR contains(b, '-') OR b rlike r'D[rR]$'"
    signed = (
        f"transform(array(coalesce(try_cast({digits} AS {MONEY}), 0)), "
        f"v -> CASE WHEN {negative} THEN -v ELSE v END)[0]"
    )
    bare = rf"transform(array(regexp_replace(t, r'(?U)[₹$€£\s]', '')), b -> {signed})[0]"
    read = f"transform(array({text}), t -> CASE WHEN t IN ({empty}) THEN 0 ELSE {bare} END)[0]"
    # plain western or Indian numbers, the usual case, need none of this
    plain = rf"{c} rlike r'^-?\d{{1,3}}(,?\d{{2,3}})*\.\d{{1,2}}$'"
    return F.expr(
        f"CASE WHEN coalesce({c}, '') = '' THEN 0 WHEN {plain} THEN coalesce(try_cast(translate({c}, ',', '') AS {MONEY}), 0) "
        f"ELSE {read} END"
    ).cast(MONEY)


def looks_like_money(c: Column, *, allow_direction: bool = False) -> Column:
    """True when the cell is one plain number with at most two decimals."""
    tail = r"(\s*(dr|cr))?" if allow_direction else ""
    return F.trim(F.translate(c, ",₹$", "")).rlike(rf"(?i)^-?\d+(\.\d{{1,2}})?{tail}$")
