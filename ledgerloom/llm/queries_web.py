"""Queries over pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reply_trees, url_filters, warc
from .common import table

URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_frame(spark, URL_RULES))


_RULE_ROWS = ", ".join(
    f"('{action}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{rule}')" for action, rule in URL_RULES
)
# The pages hold no canonical links or redirects, which the last filter of the query checks:
# with such links there would be rows to compare with the operator's own tests only.
OP1_SQL = f"""with rules(action, rule_host, rule_path, rule) as (values {_RULE_ROWS}),
parts as (
 select page_id, url, html,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') as path
 from pages),
fits as (
 select p.url, r.rule, r.action,
  row_number() over (partition by p.url order by length(r.rule) desc, r.action) as place
 from (select distinct url, host, path from parts) p join rules r
  on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select page_id, host, path, f.rule, coalesce(f.action, 'allow') as verdict
from parts p left join fits f on f.url = p.url and f.place = 1
where p.html is null or not regexp_matches(p.html, 'rel *= *.?canonical|http-equiv *= *.?refresh', 'i')"""


# A conversation whose texts hold the strings of the template.
CONTROL_ID = -7
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    control = [(CONTROL_ID, 0, "user", CONTROL_TEXT), (CONTROL_ID, 1, "assistant", CONTROL_TEXT)]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(control, columns))
    chats = reply_trees.formatted(reply_trees.chains(rows, "conv_id", "turn", "role", "text"))
    turns = reply_trees.read_turns(F.col("text"))
    read = chats.select(
        F.col("tree_id").alias("conv_id"),
        turns.alias("turns"),
        reply_trees.read_learned(F.col("text"), F.col("spans")).alias("learned"),
        F.char_length("text").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(lines, ""), "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.encode("learned", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP5_SQL = rf"""with said as (
 select conv_id, turn, role, text from conversations
 union all select {CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}'
 union all select {CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}'),
rows as (
 select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
  replace(replace(replace(coalesce(text, ''), '\', '\0'), '</turn>', '\1'), '### ', '\2') as body,
  replace(replace(replace(replace(coalesce(role, ''), '\', '\0'), '</turn>', '\1'), '### ', '\2'), chr(10), '\3') as head
 from said)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(length(head) + length(body) + 13) as bigint) as formatted_chars
from rows group by conv_id"""


# Pages have no time of their own; every record of the query carries this one.
FETCHED = "1970-01-01T00:00:00Z"


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each derived record, with its digests instead of the record itself."""
    derived = warc.derive(warc.responses(table(spark, sf_dir, "pages"), F.lit(FETCHED)))
    return derived.select(
        "page_id", "warc_type", "derived_id", "refers_to", "target_uri", "source_digest", "block_digest",
        F.octet_length("block").cast("long").alias("block_bytes"),
        F.sha2(F.encode("record", "UTF-8"), 256).alias("record_sha256"),
    )


def _sql_urn(digest: str) -> str:
    cut = " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cut} || '>'"


_NAMES = ", ".join("'{}': '{}'".format(n, v.replace("'", "''")) for n, v in warc.names().items())


def _sql_decoded(text: str) -> str:
    """References of a text, by the table ``signs`` of names and chr() of numbers."""
    whole = f"regexp_extract(p, '{warc.REFERENCE}', 1)"
    # chr() would fail on what is no character: such numbers are asked for as the replacement
    code = f"case when {whole}[2] in ('x', 'X') then cast('0x0' || {whole}[3:] as bigint) else cast('0' || {whole}[2:] as bigint) end"
    real = f"case when ({code}) between 1 and 55295 or ({code}) between 57344 and 1114111 then ({code}) else 65533 end"
    number = f"case when {whole}[1] = '#' then coalesce(signs['#' || ({code})], chr(cast({real} as integer))) else signs[{whole}] end"
    return (
        f"(string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], "
        f"lambda p: coalesce(case when {whole} <> '' then ({number}) || p[length({whole}) + 2:] end, '&' || p)), ''))"
    )


def _sql_squeezed(text: str) -> str:
    text = _sql_decoded(text)
    text = f"regexp_replace({text}, '[ \\t\\r\\f]+', ' ', 'g')"
    text = f"regexp_replace({text}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"regexp_replace({text}, '^[ \\n]+|[ \\n]+$', '', 'g')"


_CR = "chr(13) || chr(10)"
_TEXT = f"regexp_replace(regexp_replace(regexp_replace(payload, '{warc.HIDDEN}', '', 'g'), '{warc.BREAKS}', chr(10), 'g'), '{warc.TAG}', '', 'g')"
_TITLE = f"regexp_replace(regexp_extract(payload, '{warc.TITLE}', 1), '{warc.TAG}', '', 'g')"
_LINK = warc.LINK.replace("'", "''")
OP9_SQL = f"""with names as (select map {{{_NAMES}}} as signs),
source as (
 select page_id, regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') as target_uri, coalesce(html, '') as payload from pages),
named as (
 select *, md5('response' || chr(31) || coalesce(cast(page_id as varchar), chr(0)) || chr(31) || target_uri || chr(31) || md5(payload)) as rid,
  'sha256:' || sha256(payload) as source_digest from source),
blocks as (
 select page_id, target_uri, source_digest, {_sql_urn('rid')} as refers_to, unnest(['metadata', 'conversion']) as warc_type,
  unnest([
   'title: ' || replace({_sql_squeezed(_TITLE)}, chr(10), ' ') || {_CR} || 'source-digest: ' || source_digest || {_CR}
   || 'source-header: HTTP/1.1 200 OK' || {_CR} || 'source-header: Content-Type: text/html; charset=utf-8' || {_CR}
   || 'source-header: Content-Length: ' || strlen(payload) || {_CR}
   || array_to_string(list_transform(regexp_extract_all(payload, '{_LINK}', 1),
       lambda x: 'outlink: ' || regexp_replace({_sql_decoded("regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')")}, '[\\r\\n]+', ' ', 'g') || {_CR}), ''),
   {_sql_squeezed(_TEXT)}]) as block
 from named, names),
ids as (
 select *, md5(warc_type || chr(31) || refers_to) as did, 'sha256:' || sha256(block) as block_digest,
  case warc_type when 'metadata' then 'application/warc-fields' else 'text/plain; charset=utf-8' end as kind from blocks)
select page_id, warc_type, {_sql_urn('did')} as derived_id, refers_to, target_uri, source_digest, block_digest,
 cast(strlen(block) as bigint) as block_bytes,
 sha256('WARC/1.1' || {_CR} || 'WARC-Type: ' || warc_type || {_CR} || 'WARC-Record-ID: ' || {_sql_urn('did')} || {_CR}
  || 'WARC-Refers-To: ' || refers_to || {_CR} || 'WARC-Target-URI: ' || target_uri || {_CR}
  || 'WARC-Date: {FETCHED}' || {_CR} || 'WARC-Block-Digest: ' || block_digest || {_CR} || 'Content-Type: ' || kind || {_CR}
  || 'Content-Length: ' || strlen(block) || {_CR} || {_CR} || block) as record_sha256
from ids"""

QUERIES = {"op1_url_filters": op1_url_filters, "op5_reply_trees": op5_reply_trees, "op9_warc": op9_warc}
ORACLES = {"op1_url_filters": OP1_SQL, "op5_reply_trees": OP5_SQL, "op9_warc": OP9_SQL}
