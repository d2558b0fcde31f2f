"""Statement metadata from page texts: issuer, account, holder, branch, period, balances, year.

Patterns run on each page where it lies; only what they captured is shuffled. A match may
start on one page and end on the next, so the last lines of a page with the first lines of the
page after it are searched as well (``searched_texts``). The first match in text order wins, as
if the whole statement were one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.amounts import clean_amount
from ..functions.dates import YEAR_HEAD_CHARS, parse_date
from ..functions.text import capitalize, find, has_any, let, strip, title_case
from .years import chosen_year, first_hits, joined_head

KEY = ["statement_id"]
# Three lines at least, and lines until they hold 120 characters that are no white space: more
# than any pattern takes on one side, apart from the free words after "balance ... on".
BORDER = r"^(?:[^\n]*\n){0,2}(?:\s*\S){0,120}[^\n]*"
QUICK_PAGES = 3

# Account number patterns in the order they are tried.
ACCOUNT_PATTERNS = [
    r"(?i)(?:(?:Primary|Secondary|Customer|Savings|Current)\s+)?(?:Account\s*(?:Number|No\.?)"
    r"|AccountNo|A/c\s*(?:No\.?|Number)|Account\s*#|Account\s*ID|AcCount#)\s*[:\-]?\s*([X\*\d\-]{8,34})",
    r"(?i)(?:Savings\s*A/c\s*(?:No\.?|Number)?|Current\s*A/c\s*(?:No\.?|Number)?)\s*[:\-]?\s*([X\*\d\-]{8,34})",
    r"(?i)\bIBAN\s*[:\-]?\s*([A-Z]{2}\d{2}[A-Z0-9]{11,30})\b",
    r"(?i)\bAccount\s*Number\s*[:\-]?\s*(\d{8,20})\b",
    r"(?i)\b(?:A/c|Account)\s*[:\-]?\s*(\d{9,18})\b",
    r"\b(\d{11,18})\b",
]
# Clearing code and international bank code.
CLEARING_CODE = r"\b([A-Z]{4}0[A-Z0-9]{6})\b"
BANK_CODE = r"\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b"
# Holder patterns, words that disqualify a match, street-address lines.
HOLDER_PATTERNS = [
    r"(?i)(?:Customer\s*Name|Account\s*Holder\s*(?:Name)?|Account\s*Name|Customer|Client\s*Name)\s*[:\-]\s*"
    r"([A-Za-z\.\s]{2,40}?)(?=\s+(?:Account|A/c|Address|IFSC|Statement|Branch|Period|Date)|\n|$|\r)",
    r"(?i)\b(?:M/s\.?|Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Shri|Smt)\s+([A-Za-z\s\.]{3,35})(?=\s+(?:Account|A/c|Address)|\n|$|\r)",
    r"(?i)(?:Name)\s*[:\-]\s*([A-Za-z\.\s]{3,35})(?=\s+(?:Account|A/c|Address)|\n|$|\r)",
]
HOLDER_STOP = [
    "bank", "statement", "account", "address", "branch", "period", "limited", "date", "number",
]
STREET_LINE = (
    r"(?i)^\s*\d+[\s\w,\.-]*(?:Dr\.?|Drive|St\.?|Street|Ave\.?|Avenue|Rd\.?|Road|Blvd\.?|Boulevard|Lane"
    r"|Ln\.?|Way|Court|Ct\.?|Circle|Nagar|Marg|Sector|Colony)\b"
)
NOT_A_HOLDER = [
    "bank", "statement", "member", "fdic", "box", "p.o.", "branch", "page", "account", "summary",
    "balance", "total", "phone", "call", "date", "dr.",
]
# Branch, period and balance wording.
BRANCH = r"(?i)(?:Branch\s*[:\-]|Branch\s*Name\s*[:\-])\s*([A-Za-z0-9\s,\-]{3,45})(?:\n|$)"
PERIOD_PATTERNS = [
    r"(?i)(?:Statement\s*Period|Period\s*From|Period)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
    r"|\d{1,2}-[A-Za-z]{3}-\d{2,4})\s*(?:to|-|until)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}-[A-Za-z]{3}-\d{2,4})",
    r"(?i)(?:From|Between)\s*[:\-]?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})\s*(?:To|and)\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
]
BEGINNING_DATE = r"(?i)Beginning\s*Balance\s*on\s*([A-Za-z]+\s*\d{1,2},?\s*\d{4})"
ENDING_DATE = r"(?i)Ending\s*Balance\s*on\s*([A-Za-z]+\s*\d{1,2},?\s*\d{4})"
_BALANCE_TAIL = (
    r"(?:[^\d\n\r]*on\s*[A-Za-z0-9\s,]+)?\s*[:\-]?\s*(?:INR|Rs\.?|₹|\$)?\s*([+\-]?[\d,]+\.\d{2}|[+\-]?\d+)"
)
OPENING_BALANCE = rf"(?i)(?:Opening\s*Balance|Beginning\s*Balance|Balance\s*B/F|Brought\s*Forward){_BALANCE_TAIL}"
CLOSING_BALANCE = rf"(?i)(?:Closing\s*Balance|Ending\s*Balance|Balance\s*C/F|Carried\s*Forward){_BALANCE_TAIL}"
NOT_FOUND = "Not Found"
CURRENCY = "INR"

# Wording of issuer names.
REGULATOR = r"(?i)([A-Za-z0-9\.\s&-]{2,35}?)\s+(?:Member\s+FDIC|FDIC\s+Insured)"
REGULATOR_PREFIX = r"(?i)^(?:welcome\s+to|statement\s+of|the)\s+"
REGULATOR_STOP = ["welcome", "statement", "page", "primary"]
TITLE_PREFIX = (
    r"(?i)^(?:welcome\s+to|statement\s+of(?:\s+account)?|the|e-statement|account\s+statement)\s*[:\-]?\s*"
)
TITLE_SUFFIX = (
    r"(?i)(?:\s+)?(?:limited|ltd\.?|plc|n\.a\.?|corp\.?|incorporated|inc\.?|national\s+association"
    r"|branch|a/c|account).*$"
)
BANK_OF = r"(?i)\b((?:State\s+)?Bank\s+of\s+[A-Za-z\s]{2,25})\b"
NAMED_BANK = r"(?i)\b([A-Za-z0-9\.\s&-]{2,35}?\s+(?:Bank|Banking|Co-operative\s+Bank|Credit\s+Union))\b"
NOT_A_BANK = ["blood bank", "food bank", "data bank", "primary account"]
JOINED_BANK = r"(?i)\b([A-Za-z0-9]{3,12})(bank)\b"
BANK_WORDS = ["BANK", "BANKING", "CREDIT", "UNION", "CO-OPERATIVE", "COOPERATIVE"]
SHORT_NAMES = ["HDFC", "ICICI", "HSBC", "RBL", "PNB", "SBI", "IDFC", "DBS", "AXIS", "CITI"]
STATE_BANK = "State Bank of India"
BANK_URL = r"(?i)www\.([a-z0-9\-]+bank)\.(?:com|co\.in|org|net|in)"
HEADER_LINES, HEADER_LINE_CHARS = 15, 85


def searched_texts(pages: DataFrame) -> DataFrame:
    """Pages and page borders as ``(statement_id, place, text)``.

    A border holds the last lines of a page and the first lines of the next one, with any blank
    lines among them; its place lies between theirs. Only these lines are shuffled to bring
    them together.
    """
    border = lambda text: F.regexp_extract(text, BORDER, 0)
    ends = pages.select(
        *KEY,
        F.explode(
            F.array(
                F.struct(
                    F.col("page_no").alias("page_no"),
                    F.lit(0).alias("side"),
                    F.reverse(border(F.reverse("text"))).alias("text"),
                ),
                F.struct(
                    (F.col("page_no") - 1).alias("page_no"),
                    F.lit(1).alias("side"),
                    border(F.col("text")).alias("text"),
                ),
            )
        ).alias("e"),
    ).where("NOT (e.side = 1 AND e.page_no = 0)")
    end = F.max(F.when(F.col("e.side") == 0, F.col("e.text")))
    begin = F.max(F.when(F.col("e.side") == 1, F.col("e.text")))
    borders = (
        ends.groupBy(*KEY, F.col("e.page_no").alias("page_no"))
        .agg(end.alias("before"), begin.alias("after"))
        .where("before IS NOT NULL AND after IS NOT NULL")
    )
    whole = pages.select(*KEY, (F.col("page_no") * 2).cast("long").alias("place"), "text")
    return whole.unionByName(
        borders.select(
            *KEY,
            (F.col("page_no") * 2 + 1).cast("long").alias("place"),
            F.concat_ws("\n", "before", "after").alias("text"),
        )
    )


def head_text(pages: DataFrame, chars: int, *, separator: str = "\n") -> DataFrame:
    """The first ``chars`` characters of each statement, as ``head``.

    The first few pages are enough for almost every statement; only for those that are still
    short the next ones are read, and never more than can matter.
    """
    def heads(some: DataFrame) -> DataFrame:
        return some.groupBy(*KEY).agg(
            joined_head(F.col("text"), F.col("page_no"), F.col("page_no"), chars, separator).alias("head")
        )

    quick = heads(pages.where(F.col("page_no") <= QUICK_PAGES))
    longer = pages.where(F.col("page_no") > QUICK_PAGES).where(F.col("page_no") <= chars + 1)
    short = quick.where(F.length("head") < chars).select(*KEY)
    rest = heads(longer.join(short, KEY, "left_semi")).withColumnRenamed("head", "rest")
    full = F.when(
        F.col("rest").isNotNull(), F.substring(F.concat(F.col("head"), F.lit(separator), F.col("rest")), 1, chars)
    ).otherwise(F.col("head"))
    return quick.join(rest, KEY, "left").select(*KEY, full.alias("head"))


def statement_years(pages: DataFrame) -> DataFrame:
    """Year context per statement: ``(statement_id, statement_year)``."""
    hits = searched_texts(pages).groupBy(*KEY).agg(*first_hits(F.col("text"), F.col("place")))
    heads = head_text(pages, YEAR_HEAD_CHARS)
    return hits.join(heads, KEY, "left").select(*KEY, chosen_year(F.col("head")).alias("statement_year"))


def _holder_above_street(text: Column) -> Column:
    """The line above the first street-address line that can be a name."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) > 0)

    def pick(ls: Column) -> Column:
        names = F.transform(
            ls,
            lambda s, i: F.when(
                (i > 0) & s.rlike(STREET_LINE), F.get(ls, i - 1)
            ),
        )
        fits = lambda n: (
            n.isNotNull() & F.length(n).between(2, 45) & ~has_any(F.lower(n), NOT_A_HOLDER) & ~n.rlike(r"\d")
        )
        return F.get(F.filter(names, fits), F.lit(0))

    return let(lines, pick)


def captures(pages: DataFrame) -> DataFrame:
    """What the first match of every pattern says, one row per statement."""
    texts = searched_texts(pages)
    text, place = F.col("text"), F.col("place")
    patterns = {
        **{f"acc{i}": (p, 1) for i, p in enumerate(ACCOUNT_PATTERNS)},
        "ifsc": (CLEARING_CODE, 1),
        "swift": (BANK_CODE, 1),
        **{f"name{i}": (p, 1) for i, p in enumerate(HOLDER_PATTERNS)},
        "branch": (BRANCH, 1),
        **{f"from{i}": (p, 1) for i, p in enumerate(PERIOD_PATTERNS)},
        **{f"to{i}": (p, 2) for i, p in enumerate(PERIOD_PATTERNS)},
        "beginning": (BEGINNING_DATE, 1),
        "ending": (ENDING_DATE, 1),
        "opening": (OPENING_BALANCE, 1),
        "closing": (CLOSING_BALANCE, 1),
    }
    found = texts.select(
        *KEY,
        "place",
        "text",
        *[find(text, p, g).alias(n) for n, (p, g) in patterns.items()],
        _holder_above_street(text).alias("above_street"),
    )
    names = [*patterns, "above_street"]
    return found.groupBy(*KEY).agg(
        *[F.min_by(n, F.when(F.col(n).isNotNull(), place)).alias(n) for n in names],
        *first_hits(text, place),
    )


def account_details(pages: DataFrame, *, default_year: int) -> DataFrame:
    """Account number, codes, holder, branch, period and stated balances of each statement."""
    heads = head_text(pages, YEAR_HEAD_CHARS)
    found = captures(pages).join(heads, KEY, "left").withColumn("year", chosen_year(F.col("head")))

    accounts = [strip(F.col(f"acc{i}")) for i in range(len(ACCOUNT_PATTERNS))]
    holders = []
    for i in range(len(HOLDER_PATTERNS)):
        name = strip(F.col(f"name{i}"))
        holders.append(F.when(~has_any(F.lower(name), HOLDER_STOP), name))
    stated_from = F.coalesce("from0", "from1")
    # both ends come from the same pattern
    stated_to = F.when(F.col("from0").isNotNull(), F.col("to0")).otherwise(F.col("to1"))
    found = found.select(
        "*",
        stated_from.alias("_from"),
        stated_to.alias("_to"),
    )
    dates = {
        n: parse_date(c, "year", default_year=default_year)
        for n, c in {"d_from": "_from", "d_to": "_to", "d_beg": "beginning", "d_end": "ending"}.items()
    }
    found = found.withColumns(dates)
    iso = lambda c: F.date_format(F.col(c)["date"], "yyyy-MM-dd")
    no_range = F.col("_from").isNull()
    start = F.when(no_range, F.when(F.col("ending").isNotNull(), iso("d_beg"))).otherwise(
        F.coalesce(iso("d_from"), F.col("_from"))
    )
    end = F.when(no_range, iso("d_end")).otherwise(F.coalesce(iso("d_to"), F.col("_to")))
    return found.select(
        *KEY,
        F.coalesce(*holders, "above_street", F.lit(NOT_FOUND)).alias("account_holder"),
        F.coalesce(*accounts, F.lit(NOT_FOUND)).alias("account_number"),
        F.coalesce("ifsc", "swift").alias("ifsc_code"),
        strip(F.col("branch")).alias("branch"),
        start.alias("statement_period_start"),
        end.alias("statement_period_end"),
        F.when(F.col("opening").isNotNull(), clean_amount("opening")).alias("opening_balance"),
        F.when(F.col("closing").isNotNull(), clean_amount("closing")).alias("closing_balance"),
        F.lit(CURRENCY).alias("currency"),
        F.col("year").alias("statement_year"),
    )


def _named(name: Column, confidence: float) -> Column:
    return F.struct(name.alias("name"), F.lit(confidence).alias("confidence"))


def _line_issuer(line: Column) -> Column:
    """Issuer named by one header line: "Bank of X", then "X Bank", then "XBANK"."""

    def read(clean: Column) -> Column:
        india = _named(F.lit(f"{STATE_BANK} (SBI)"), 0.95)
        words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 0)
        bank_of = F.array_join(
            F.transform(
                words(F.regexp_extract(clean, BANK_OF, 1)),
                lambda w: F.when(F.lower(w) == "of", F.lit("of")).otherwise(capitalize(w)),
            ),
            " ",
        )
        raw = F.trim(F.regexp_extract(clean, NAMED_BANK, 1))
        named = F.array_join(
            F.transform(
                words(raw),
                lambda w: F.when(F.upper(w).isin(BANK_WORDS), capitalize(w))
                .when(
                    (F.length(w) <= 4)
                    & (((w == F.upper(w)) & w.rlike("[A-Z]")) | F.upper(w).isin(SHORT_NAMES)),
                    F.upper(w),
                )
                .otherwise(capitalize(w)),
            ),
            " ",
        )
        joined = F.concat(F.upper(F.regexp_extract(clean, JOINED_BANK, 1)), F.lit(" Bank"))
        return (
            F.when(
                clean.rlike(BANK_OF),
                F.when(bank_of.contains(STATE_BANK), india).otherwise(_named(bank_of, 0.92)),
            )
            .when(
                clean.rlike(NAMED_BANK) & ~has_any(F.lower(raw), NOT_A_BANK),
                F.when(named.contains(STATE_BANK), india).otherwise(_named(named, 0.92)),
            )
            .when(clean.rlike(JOINED_BANK), _named(joined, 0.90))
        )

    bare = strip(F.regexp_replace(strip(F.regexp_replace(line, TITLE_PREFIX, "")), TITLE_SUFFIX, ""))
    return let(bare, read)


def clearing_table(spark) -> DataFrame:
    """Clearing prefixes and issuer names: a fixed table of 31 rows, safe to broadcast."""
    return spark.createDataFrame(list(K.CLEARING_PREFIXES.items()), "prefix string, issuer string")


def issuer_lookup(codes: DataFrame, code: str) -> DataFrame:
    """Issuer of a clearing code: ``issuer`` and ``issuer_confidence``.

    An unknown prefix gives its own name with a lower confidence.
    """
    prefix = F.substring(code, 1, 4)
    known = F.broadcast(clearing_table(codes.sparkSession))
    return (
        codes.withColumn("prefix", prefix)
        .join(known, "prefix", "left")
        .withColumn("issuer_confidence", F.when(F.col("issuer").isNotNull(), F.lit(0.95)).otherwise(F.lit(0.85)))
        .withColumn("issuer", F.coalesce("issuer", F.concat(F.col("prefix"), F.lit(" Bank"))))
    )


def detect_issuers(pages: DataFrame) -> DataFrame:
    """``(statement_id, bank_name, bank_confidence)`` from the first 3000 characters.

    Regulator anchor, header lines, web address, clearing code, in this order.
    """
    heads = head_text(pages, K.SAMPLE_CHARS).withColumn("head", strip(F.col("head")))
    head = F.col("head")
    anchor = strip(F.regexp_replace(strip(F.regexp_extract(head, REGULATOR, 1)), REGULATOR_PREFIX, ""))
    by_anchor = F.when(
        (F.length("_anchor") >= 3) & ~has_any(F.lower("_anchor"), REGULATOR_STOP),
        _named(title_case(F.col("_anchor")), 0.95),
    )
    lines = F.slice(
        F.filter(F.transform(F.split(head, "\n"), strip), lambda s: F.length(s) > 0), 1, HEADER_LINES
    )
    by_line = F.get(
        F.filter(
            F.transform(F.filter(lines, lambda s: F.length(s) <= HEADER_LINE_CHARS), _line_issuer),
            lambda r: r.isNotNull(),
        ),
        F.lit(0),
    )
    url = find(head, BANK_URL, 1)
    by_url = F.when(url.isNotNull(), _named(title_case(url), 0.88))
    coded = issuer_lookup(
        heads.withColumn("_anchor", anchor).withColumn("_code", find(head, CLEARING_CODE, 1)), "_code"
    )
    by_code = F.when(
        F.col("_code").isNotNull(),
        F.struct(F.col("issuer").alias("name"), F.col("issuer_confidence").alias("confidence")),
    )
    chosen = F.coalesce(by_anchor, by_line, by_url, by_code, _named(F.lit(K.GENERIC_ISSUER), 0.50))
    return coded.select(*KEY, chosen.alias("b")).select(
        *KEY, F.col("b.name").alias("bank_name"), F.col("b.confidence").alias("bank_confidence")
    )


def redetect(first: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Where the first detection is generic or missing, take the one from the rebuilt text instead."""
    second = rebuilt.select(
        *KEY, F.col("bank_name").alias("_name"), F.col("bank_confidence").alias("_confidence")
    )
    first = first.join(second, KEY, "full").na.fill({"bank_name": K.GENERIC_ISSUER, "bank_confidence": 0.50})
    replace = F.col("bank_name").isin(K.GENERIC_ISSUERS) & F.col("_name").isNotNull() & ~F.col("_name").isin(K.GENERIC_ISSUERS)
    return first.select(
        *KEY,
        F.when(replace, F.col("_name")).otherwise(F.col("bank_name")).alias("bank_name"),
        F.when(replace, F.col("_confidence")).otherwise(F.col("bank_confidence")).alias("bank_confidence"),
    )


__all__ = [
    "account_details", "clearing_table", "detect_issuers", "head_text",
    "issuer_lookup", "redetect", "searched_texts", "statement_years",
]
