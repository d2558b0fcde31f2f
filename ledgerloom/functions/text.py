"""Small text expressions shared by the parsers. All of them stay on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


# White space of any kind, as it may stand at the ends of a text.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Drop white space (tabs and line breaks too) at both ends."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def squeeze(c: Column) -> Column:
    """Turn every run of white space into one space and strip the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def find(c: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern`` (or one of its groups); null when there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def first_letters(words: list[str]) -> str:
    """Look-ahead for the first letters of the words: most places of a text fail it at once."""
    return "(?=[" + "".join(sorted({re.escape(w[0]) for w in words})) + "])"


def literals(words: list[str]) -> str:
    """A pattern that matches any of the words as plain text."""
    plain = "|".join(re.escape(w).replace("\\ ", " ") for w in words)
    return f"(?:{first_letters(words)}(?:{plain}))"


def has_any(c: Column, words: list[str]) -> Column:
    return c.rlike(literals(words))


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the other letters."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def capitalize(c: Column) -> Column:
    """Upper-case the first character and lower-case the rest."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.call_function("substring", c, F.lit(2))))


def repair_wraps(c: Column) -> Column:
    """Glue a single letter that a line wrap split from its word (``Z EPTO`` -> ``ZEPTO``)."""
    return F.regexp_replace(squeeze(c), r"\b([A-Za-z])\s+([A-Za-z]{3,}\b)", "$1$2")


def normalize_narration(c: Column) -> Column:
    """Narration text for the classifier: no references, separators or bare numbers."""
    t = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b\d{6,}\b", " ")
    t = F.regexp_replace(t, r"[/\\:\-_#@\.]", " ")
    return squeeze(F.regexp_replace(t, r"\b\d+\b", " "))
