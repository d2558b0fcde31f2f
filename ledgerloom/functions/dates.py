"""Dates in the wording of statements: day first, month names, two-part dates, years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import find

# Accepted years; two-digit years outside 90-99 and 00-40 are not dates.
FIRST_YEAR, LAST_YEAR = 1990, 2040

# Month names, short and long.
SHORT_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
LONG_MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september",
    "october", "november", "december",
]

# Where a three-part date may sit inside a text, in the order they are tried.
DATE_PATTERNS = [
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    r"\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    r"\b\d{1,2}/\d{1,2}/\d{2}\b",
    r"\b\d{1,2}-\d{1,2}-\d{2}\b",
    r"\b\d{1,2}\.\d{1,2}\.\d{2}\b",
    r"\b\d{1,2}-[A-Za-z]{3,9}-\d{4}\b",
    r"\b\d{1,2}-[A-Za-z]{3}-\d{2}\b",  # no long month before a two-digit year
    r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4}\b",
    r"\b\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2}\b",
    r"\b[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4}\b",
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{4}/\d{2}/\d{2}\b",
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
]
NUMERIC_PATTERNS, MONTH_NAME_PATTERNS, ISO_PATTERNS = (
    DATE_PATTERNS[:6], DATE_PATTERNS[6:11], DATE_PATTERNS[11:],
)
# A text that is one such date and nothing else.
WHOLE_NUMERIC = r"^\d{1,2}([/\-.])\d{1,2}\1(\d{4}|\d{2})$"
WHOLE_MONTH_NAME = (
    r"^(\d{1,2}-[A-Za-z]{3,9}-\d{4}|\d{1,2}\s+[A-Za-z]{3,9}\s+(\d{4}|\d{2})"
    r"|[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{4})$"
)
QUICK_DAY_FIRST = r"^\d{2}([/.\-])\d{2}\1(199\d|20[0-3]\d|2040)$"
QUICK_ISO = r"^(199\d|20[0-3]\d|2040)-\d{2}-\d{2}$"
# What a text must hold before a family of patterns can give a date, cheap to look for first.
THREE_NUMBERS = r"\d([/\-.])\d{1,2}\1\d\d"
MONTH_BEGIN = rf"(?i)(?=[jfmasond])(?:{'|'.join(SHORT_MONTHS)})"
YEAR_FIRST = r"\d{4}([-/])\d{1,2}\1\d"
TWO_NUMBERS = r"\d[/.\-]\d"
# Usual amounts: no date, as no two digits stand alone before the point.
NO_DATE = r"^-?[\d,]*\d{3}\.\d\d$"
# Two-part dates: name and day, day and name, two numbers.
TWO_PART_PATTERNS = [
    r"\b([A-Za-z]{3,9})\s*(\d{1,2})\b",
    r"\b(\d{1,2})\s*([A-Za-z]{3,9})\b",
    r"\b(\d{1,2})[/.\-](\d{1,2})\b",
]

# Where a statement says its year, in the order they are tried.
YEAR_PATTERNS = [
    (r"(?i)(?:Statement\s*Date|Date\s*of\s*Statement|Statement\s*as\s*of)\s*[:\-]?\s*"
     r"(?:[A-Za-z]+\s*\d{1,2},?\s*(\d{4})|\d{1,2}[/-]\d{1,2}[/-](\d{4}))", (1, 2)),
    (r"(?i)(?:Ending\s*Balance|Beginning\s*Balance)\s*on\s*[A-Za-z]+\s*\d{1,2},?\s*(\d{4})", (1,)),
    (r"(?i)(?:Statement\s*Period|Period\s*From|Period)(?:.*?)\b(19\d\d|20\d\d)\b", (1,)),
    (r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November"
     r"|December)\s*\d{1,2},?\s*(19\d\d|20\d\d)\b", (1,)),
    (r"\b\d{1,2}[/-]\d{1,2}[/-](19\d\d|20\d\d)\b", (1,)),
]
# Words without which a year pattern cannot match, cheap to look for first.
YEAR_WORDS = ["(?i)statement", "(?i)balance", "(?i)period", "(?i)(?=[JFMASOND])(?:ja|fe|mar|ap|may|ju|au|se|oc|no|de)", r"\d[/-]\d"]
YEAR_TOKEN = r"\b(19\d\d|20\d\d)\b"
YEAR_HEAD_CHARS = 2000


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _month(name: str) -> str:
    """Month number of a short or long month name; digits stay as they are."""
    names = ", ".join(f"'{m}'" for m in SHORT_MONTHS + LONG_MONTHS)
    return (
        f"CASE WHEN {name} rlike r'^\\d' THEN try_cast({name} AS int) "
        f"ELSE nullif((array_position(array({names}), lower({name})) - 1) % 12 + 1, 0) END"
    )


def _window_year(text: str) -> str:
    """Four- or two-digit year text to a year of the accepted window, else null."""
    full = (
        "CASE WHEN length(t) = 4 THEN CASE WHEN int(t) < 1970 THEN int(t) + 100 ELSE int(t) END "
        "WHEN int(t) >= 90 THEN int(t) + 1900 ELSE int(t) + 2000 END"
    )
    year = _let(full, "y", f"CASE WHEN y BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN y END")
    return _let(text, "t", year)


def _first_day(year: str, readings: list[tuple[str, str]]) -> str:
    """First (month, day) reading that is a real day of the year.

    try_cast gives null for days such as 31 February; a missing part never makes three parts.
    """
    texts = ", ".join(f"concat_ws('-', {year}, {month}, {day})" for month, day in readings)
    days = f"transform(array({texts}), t -> CASE WHEN t rlike r'^\\d+-\\d+-\\d+$' THEN try_cast(t AS date) END)"
    return f"get(filter({days}, d -> d IS NOT NULL), 0)"


def _three_part(m: str) -> str:
    """Date of a matched three-part text: year first, name first, or day first.

    Two numbers are read day first, and month first when that is no date.
    """
    body = _first_day(
        _window_year("CASE WHEN p[0] rlike '^[0-9]{4}' THEN p[0] ELSE p[2] END"),
        [
            (
                _month("CASE WHEN p[0] rlike '^[A-Za-z]' THEN p[0] ELSE p[1] END"),
                "CASE WHEN p[0] rlike '^[0-9]{4}' THEN p[2] WHEN p[0] rlike '^[A-Za-z]' THEN p[1] ELSE p[0] END",
            ),
            (
                "CASE WHEN length(p[0]) <= 2 AND p[1] rlike r'^\\d' THEN p[0] END",
                "p[1]",
            ),
        ],
    )
    return _let(rf"split({m}, r'[/\-.,\s]+')", "p", body)


def _two_part(m: str, year: str) -> str:
    """Date of a matched two-part text; two numbers are read month first."""
    parts = rf"split(regexp_replace({m}, r'^(\d+|[A-Za-z]{{3}})[A-Za-z]*[\s/.\-]*(\d+|[A-Za-z]{{3}})[A-Za-z]*$', '$1-$2'), '-')"
    day_named = "p[1] rlike '^[A-Za-z]'"
    body = _first_day(
        year,
        [
            (_month(f"CASE WHEN {day_named} THEN p[1] ELSE p[0] END"), f"CASE WHEN {day_named} THEN p[0] ELSE p[1] END"),
            (r"CASE WHEN NOT concat(p[0], p[1]) rlike '[A-Za-z]' THEN p[1] END", "p[0]"),
        ],
    )
    return _let(parts, "p", body)


def date_sql(c: str, statement_year: str | None = None, *, default_year: int) -> str:
    """SQL text of ``parse_date``; ``c`` and ``statement_year`` are SQL expressions."""
    year = str(default_year)
    if statement_year:
        year = (
            f"CASE WHEN {statement_year} BETWEEN {FIRST_YEAR} AND {LAST_YEAR} THEN {statement_year} ELSE {default_year} END"
        )

    def first(guard: str, whole: str | None, patterns: list[str], read: str) -> str:
        found = ", ".join(f"regexp_extract(s, r'{p}', 0)" for p in patterns)
        matches = f"filter(array({found}), m -> m <> '')"
        if whole:  # the text is one date and nothing else: no need to search in it
            matches = f"CASE WHEN s rlike r'{whole}' THEN array(s) ELSE {matches} END"
        dated = f"transform({matches}, m -> struct({read} AS date, m AS raw))"
        return f"CASE WHEN s rlike r'{guard}' THEN get(filter({dated}, d -> d.date IS NOT NULL), 0) END"

    three, two = _three_part("m"), _two_part("m", year)
    body = (
        "coalesce("
        + ", ".join(
            [
                first(THREE_NUMBERS, WHOLE_NUMERIC, NUMERIC_PATTERNS, three),
                first(MONTH_BEGIN, WHOLE_MONTH_NAME, MONTH_NAME_PATTERNS, three),
                first(YEAR_FIRST, None, ISO_PATTERNS, three),
                # a name that is no month gives no date; two numbers are tried after the names
                first(MONTH_BEGIN, None, TWO_PART_PATTERNS[:2], two),
                first(TWO_NUMBERS, None, TWO_PART_PATTERNS[2:], two),
            ]
        )
        + ")"
    )
    # the two most usual wordings are read directly
    day = f"try_cast(concat(substr({c}, 7, 4), '-', substr({c}, 4, 2), '-', substr({c}, 1, 2)) AS date)"
    quick = (
        rf"CASE WHEN {c} rlike r'{QUICK_DAY_FIRST}' AND {day} IS NOT NULL THEN struct({day} AS date, {c} AS raw) "
        rf"WHEN {c} rlike r'{QUICK_ISO}' AND try_cast({c} AS date) IS NOT NULL THEN struct(try_cast({c} AS date) AS date, {c} AS raw) END"
    )
    stripped = rf"regexp_replace({c}, r'^\s+|\s+$', '')"
    return rf"CASE WHEN {c} rlike r'\d' AND NOT {c} rlike r'{NO_DATE}' THEN coalesce({quick}, {_let(stripped, 's', body)}) END"


def parse_date(c: str, statement_year: str | None = None, *, default_year: int) -> Column:
    """``struct<date, raw>`` of the first date in a text column, or null.

    Three-part dates are read day first, month first only when the day-first reading is
    impossible. Two-part dates take ``statement_year``, or ``default_year`` where that is
    null or outside the accepted years. The patterns are tried in order; one whose first
    match is no real date gives way to the next. Pattern families are only tried on texts
    that can hold them.
    """
    return F.expr(date_sql(c, statement_year, default_year=default_year))


def stated_year(c: Column, which: int) -> Column:
    """Year that the ``which``-th year pattern finds in a text, within the accepted years."""
    pattern, groups = YEAR_PATTERNS[which]
    years = [find(c, pattern, g).cast("int") for g in groups]
    return F.coalesce(*[F.when(y.between(FIRST_YEAR, LAST_YEAR), y) for y in years])


def year_tokens(c: Column) -> Column:
    """All four-digit years of a text that lie within the accepted years, in text order."""
    years = F.regexp_extract_all(c, F.lit(YEAR_TOKEN), F.lit(1)).cast("array<int>")
    return F.filter(years, lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def modal_year(years: Column) -> Column:
    """Most frequent entry of an array of years; the earliest seen wins a tie."""
    count = lambda y: F.size(F.filter(years, lambda x: x == y))
    ranked = F.transform(
        F.array_distinct(years),
        lambda y: F.struct(
            count(y).alias("n"), (-F.array_position(years, y)).alias("first"), y.alias("year")
        ),
    )
    return F.array_max(ranked)["year"]
