"""WARC derivatives: metadata and plain-text conversion records of response records.

Each response gives one ``metadata`` record (title, links, source headers, digests) and one
``conversion`` record (the text of its html). Both name the response they come from, carry its
target, date and payload digest, and have digests of their own blocks. No row meets another
one, so nothing is shuffled, however the responses are spread.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
CRLF = "\r\n"
# Invisible parts, block tags that end a line, and any other tag.
HIDDEN = r"(?is)<!--.*?-->|<script[ >/].*?</script[ ]*>|<style[ >/].*?</style[ ]*>"
BREAKS = (
    r"(?i)<(?:br|hr|/?p|/?div|/?li|/?ul|/?ol|/?h[1-6]|/?tr|/?table|/?title|/?head|/?body|/?nav|/?article|/?section)"
    r"(?:[ \t\r\n/][^>]*)?>"
)
TAG = r"<[^>]*>"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
# An anchor whose target is in double quotes, in single quotes, or in none.
LINK = r"(?i)<a[ \t\r\n](?:[^>]*?[ \t\r\n])?href[ \t\r\n]*=[ \t\r\n]*(\"[^\"]*\"|'[^']*'|[^ \t\r\n\"'>]+)"
REFERENCE = r"^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,8}|[A-Za-z][A-Za-z0-9]*);"
UNKNOWN_CHARACTER = "\ufffd"


def names() -> dict[str, str]:
    """Signs by reference without & and ;: the standard names, and numbers that stand for others.

    Numbers 128 to 159 are read as Windows-1252, as browsers do; the no-break space is a space.
    """
    found = {name[:-1]: sign for name, sign in html5.items() if name.endswith(";")}
    for code in range(0x80, 0xA0):
        sign = bytes([code]).decode("cp1252", errors="ignore")
        if sign:
            found[f"#{code}"] = sign
    return {name: sign.replace("\xa0", " ") for name, sign in found.items()} | {"#160": " "}


def _named(reference: Column) -> Column:
    """The sign of a name, looked up among the names of its first letter."""
    groups: dict[str, list[str]] = {}
    for name, sign in names().items():
        groups.setdefault(name[0], []).append(f"{name}\x1f{sign}")
    table = [(F.lit(first), F.str_to_map(F.lit("\x1e".join(pairs)), F.lit("\x1e"), F.lit("\x1f"))) for first, pairs in groups.items()]
    return F.element_at(F.element_at(F.create_map(*[x for pair in table for x in pair]), F.substring(reference, 1, 1)), reference)


def _numbered(code: Column) -> Column:
    """The character of a code point; none such gives the replacement character."""
    real = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code < 0x110000))
    sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(real, sign).otherwise(F.lit(UNKNOWN_CHARACTER))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def decoded(text: Column) -> Column:
    """Character references as characters, each read once; unknown names stay as they are written."""

    def code(whole: Column) -> Column:
        hexadecimal = F.substring(whole, 2, 1).isin("x", "X")
        return F.when(hexadecimal, F.conv(F.substring(whole, 3, 8), 16, 10)).otherwise(F.substring(whole, 2, 9)).cast("long")

    def sign(whole: Column) -> Column:
        # the table lists plain numbers, without zeros before them
        number = _once(code(whole), lambda c: F.coalesce(_named(F.concat(F.lit("#"), c.cast("string"))), _numbered(c)))
        return F.when(F.startswith(whole, F.lit("#")), number).when(whole != "", _named(whole))

    def read(piece: Column) -> Column:
        def put(whole: Column) -> Column:
            rest = F.substr(piece, F.length(whole) + 2)
            return F.coalesce(F.concat(sign(whole), rest), F.concat(F.lit("&"), piece))

        return _once(F.regexp_extract(piece, REFERENCE, 1), put)

    def joined(pieces: Column) -> Column:
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), read), ""))

    return _once(text, lambda t: F.when(F.contains(t, F.lit("&")), _once(F.split(t, "&"), joined)).otherwise(t))


def _squeezed(text: Column) -> Column:
    """White space between words as one space, between lines as one line break."""
    text = decoded(text)
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def plain_text(html: Column) -> Column:
    """The visible text: a line for each block, entities as characters; null gives none."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "")
    text = F.regexp_replace(F.regexp_replace(text, BREAKS, "\n"), TAG, "")
    return _squeezed(text)


def title(html: Column) -> Column:
    found = F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)
    return F.regexp_replace(_squeezed(F.regexp_replace(found, TAG, "")), "\n", " ")


def links(html: Column) -> Column:
    """Targets of the links in order, without quotes; references are decoded, line breaks are spaces."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK), F.lit(1))
    quoted = lambda x: F.startswith(x, F.lit('"')) | F.startswith(x, F.lit("'"))
    bare = F.transform(found, lambda x: F.when(quoted(x), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x))
    return F.transform(bare, lambda x: F.regexp_replace(decoded(x), r"[\r\n]+", " "))


def record_id(*parts: Column) -> Column:
    """A name that depends on ``parts`` alone, so that a task run again gives the same one."""
    return _urn(F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])))


def _urn(digest: Column) -> Column:
    cut = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(block, "UTF-8"), 256))


def _lines(*pairs: tuple[str, Column]) -> Column:
    """``name: value`` lines; those with a null value are left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)) for name, value in pairs])


def responses(pages: DataFrame, date: Column) -> DataFrame:
    """Pages (page_id, url, html) as response records.

    A null url is an empty target; null html an empty payload. ``date`` is the time of the fetch.
    """
    payload = F.coalesce("html", F.lit(""))
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ")
    length = F.octet_length(payload).cast("string")
    return pages.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), target, F.md5(payload)).alias("record_id"),
        target.alias("target_uri"),
        date.alias("date"),
        F.array(
            F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"), F.concat(F.lit("Content-Length: "), length)
        ).alias("http_headers"),
        payload.alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records for each response: metadata and conversion.

    Read columns: record_id, target_uri, date, http_headers (array of lines), payload; any other
    column is carried along unless its name is one of the result's. Null headers count as none,
    a null payload as empty, and nulls elsewhere leave their header line out. Repeated responses
    give repeated records. Columns added: warc_type, derived_id, refers_to, content_type, block,
    block_digest, source_digest and record, the whole record without the blank lines at its end.
    """
    payload = F.coalesce("payload", F.lit(""))
    headers = F.coalesce("http_headers", F.array().cast("array<string>"))
    named = F.transform(headers, lambda h: F.concat(F.lit("source-header: "), h, F.lit(CRLF)))
    out = F.transform(links(payload), lambda x: F.concat(F.lit("outlink: "), x, F.lit(CRLF)))
    about = F.concat(
        _lines(("title", title(payload)), ("source-digest", digest(payload))),
        F.array_join(named, ""),
        F.array_join(out, ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), about.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(payload).alias("block")),
    )
    made = ["warc_type", "derived_id", "refers_to", "content_type", "block", "block_digest", "source_digest", "record"]
    rest = [c for c in source.columns if c not in [*made, "payload", "http_headers"]]
    rows = source.select(*rest, digest(payload).alias("source_digest"), F.explode(kinds).alias("kind")).select(
        *rest,
        F.col("record_id").alias("refers_to"),
        "source_digest",
        "kind.*",
        record_id(F.col("kind.warc_type"), F.col("record_id")).alias("derived_id"),
    )
    rows = rows.withColumn("block_digest", digest(F.col("block")))
    head = _lines(
        ("WARC-Type", F.col("warc_type")),
        ("WARC-Record-ID", F.col("derived_id")),
        ("WARC-Refers-To", F.col("refers_to")),
        ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    record = F.concat(F.lit(VERSION + CRLF), head, F.lit(CRLF), F.col("block"))
    return rows.withColumn("record", record).select(*rest, *made)


def write(derived: DataFrame, path: str) -> None:
    """The records as WARC files, one for each partition: a record ends with two line ends."""
    derived.select(F.col("record").alias("value")).write.option("lineSep", CRLF * 2).text(path)
