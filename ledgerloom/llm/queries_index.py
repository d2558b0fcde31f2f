"""Queries over documents: secrets, ranked search and the manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical, merkle, secret_scan
from .common import ascii_lower, doc_remainder, table


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a repository of its own, its source is the owner."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"))
    return found.select(
        "doc_id",
        *[secret_scan.count_of(F.col("base"), k.name).alias(f"n_{k.name}") for k in secret_scan.BASE],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def _sql_matches(number: int, kind: secret_scan.Kind) -> str:
    """Rows (doc_id, source, start, kind, stop, value) of one pattern, places by the lengths in between."""
    pattern = kind.pattern.replace("'", "''")
    before = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    return f"""select doc_id, source, start, {number} as kind, start + length(hit) as stop, value from (
 select doc_id, source, cast({before} as bigint) as start, hits[i] as hit, vals[i] as value
 from (select *, unnest(range(1, len(hits) + 1)) as i from (
  select doc_id, source, regexp_extract_all(coalesce(text, ''), '{pattern}') as hits,
   regexp_extract_all(coalesce(text, ''), '{pattern}', {kind.group}) as vals,
   regexp_split_to_array(coalesce(text, ''), '{pattern}') as gaps from documents)))
where length(value) >= {kind.least}"""


_KINDS = secret_scan.BASE + secret_scan.WIDER
_NAMES = "[" + ", ".join(f"'{k.name}'" for k in _KINDS) + "]"
_SPAN = f"{_NAMES}[kind + 1] || ':' || start || ':' || stop"
_BASE_COUNTS = ", ".join(f"count(*) filter (kind = {i}) as n_{k.name}" for i, k in enumerate(secret_scan.BASE))
_BASE_ZEROS = ", ".join(f"cast(coalesce(n_{k.name}, 0) as bigint) as n_{k.name}" for k in secret_scan.BASE)
OP11_SQL = f"""with found as ({' union all '.join(_sql_matches(i, k) for i, k in enumerate(_KINDS))}),
chars as (
 select value, sum(n) as size, -sum(n * log2(n / size)) / any_value(size) as bits from (
  select value, c, count(*) as n, any_value(length(value)) as size
  from (select value, unnest(string_split(value, '')) as c from (select distinct value from found)) group by value, c)
 group by value),
held as (select value, count(distinct coalesce('=' || source, '')) as owners from found group by value),
live as (
 select value from held join chars using (value)
 where owners <= {secret_scan.OWNERS} and bits >= {secret_scan.LIVE_BITS} and regexp_matches(value, '[0-9]') and regexp_matches(value, '[A-Za-z]')),
base as (select * from found where kind < {len(secret_scan.BASE)}),
wide as (
 select f.* from found f join live using (value)
 where kind >= {len(secret_scan.BASE)} and not exists (
  select 1 from base b where b.doc_id = f.doc_id and b.start <= f.start and f.stop <= b.stop)),
told as (
 select doc_id, {_BASE_COUNTS}, string_agg({_SPAN}, ',' order by start, kind) as written from base group by doc_id),
every as (
 select doc_id, string_agg({_SPAN}, ',' order by start, kind) as spans
 from (select * from base union all select * from wide) group by doc_id)
select d.doc_id, {_BASE_ZEROS}, sha256(coalesce(written, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join told using (doc_id) left join every using (doc_id)"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""with words as (select doc_id, unnest({_TERMS}) as term from documents),
asked as (select distinct item_id, unnest({_TERMS}) as term from benchmark),
tfs as (select doc_id, term, count(*) as tf from words group by doc_id, term),
lens as (select doc_id, sum(tf) as n from tfs group by doc_id),
whole as (select count(*) as docs, cast(sum(n) as bigint) as tokens from lens),
weights as (
 select term, cast(floor(1000 * ln((2.0::double * docs + 2) / (2.0::double * count(*) + 1))) as bigint) as w
 from tfs, whole group by term, docs),
ms as (select doc_id, 100 - 50 + (50 * cast(n as bigint) * docs) // tokens as m from lens, whole),
scored as (
 select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) as bigint) as score
 from asked join tfs using (term) join weights using (term) join ms using (doc_id) group by item_id, doc_id),
ranked as (
 select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, score from ranked where rank <= 50"""


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, folded from leaves of which a third are tampered with."""
    docs = table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars")
    tampered = merkle.leaf(*[F.col(c) for c in columns], ascii_lower(F.col("text")))
    leaves = docs.select(
        "doc_id",
        "lang",
        merkle.leaf(*[F.col(c) for c in columns], F.col("text")).alias("digest"),
        F.when(doc_remainder(F.col("doc_id"), 3) == 0, tampered).alias("shown"),
    )
    manifest = merkle.build(leaves, F.col("lang"), "doc_id")
    found = manifest.leaves(
        lambda m, path: F.struct(
            m["doc_id"].alias("doc_id"),
            m["digest"].alias("leaf"),
            merkle.proof_digest(path).alias("proof_sha256"),
            merkle.fold(F.coalesce(m["shown"], m["digest"]), path).alias("folded_root"),
        )
    )
    return found.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def _sql_leaf(text: str) -> str:
    named = [f"cast({c} as varchar)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in named) + ")"


def _sql_sides(nodes: str) -> str:
    """For each node its siblings: l and r, joined in order."""
    return f"""select a.tree, a.level, a.idx,
 coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx < a.idx), '') as l,
 coalesce(string_agg(b.digest, '' order by b.idx) filter (b.idx > a.idx), '') as r
 from {nodes} a join {nodes} b on a.tree = b.tree and a.level = b.level and a.idx // 8 = b.idx // 8
 where a.n > 1 group by a.tree, a.level, a.idx"""


# DuckDB has no crc32 of its own: the remainders come from a bitwise one over the digits.
_CRC = """(select doc_id, cast(doc_id as varchar) as digits from (select distinct doc_id from documents where doc_id is not null))"""
OP13_SQL = f"""with recursive octets(doc_id, digits, spot, value) as (
 select doc_id, digits, 1, 4294967295::bigint from {_CRC}
 union all
 select doc_id, digits, spot + 1,
  list_reduce([xor(value, ascii(digits[spot])::bigint), 0, 0, 0, 0, 0, 0, 0, 0],
   lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)
 from octets where spot <= length(digits)),
picked as (select doc_id as picked_id, xor(value, 4294967295::bigint) % 3 = 0 as tampered from octets where spot = length(digits) + 1),
docs as (
 select d.doc_id, coalesce('=' || lang, '') as tree, {_sql_leaf('text')} as leaf,
  case when tampered then {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} else {_sql_leaf('text')} end as shown
 from documents d left join picked on picked_id = doc_id),
leaves as (
 select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by tree) as n from docs),
nodes(tree, level, idx, n, digest) as (
 select tree, 0, idx, n, leaf from leaves
 union all
 select tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx))
 from nodes where n > 1 group by tree, level, idx // 8, n),
subroots as (select tree, digest as subroot, row_number() over (order by tree) - 1 as idx, count(*) over () as n from nodes where n = 1),
tops(tree, level, idx, n, digest) as (
 select '', 0, idx, n, subroot from subroots
 union all
 select tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by idx))
 from tops where n > 1 group by tree, level, idx // 8, n),
sides as ({_sql_sides('nodes')}),
top_sides as ({_sql_sides('tops')}),
up(tree, leaf_idx, level, idx, proof, node) as (
 select tree, idx, 0, idx, '', shown from leaves
 union all
 select u.tree, leaf_idx, u.level + 1, u.idx // 8, proof || l || r, sha256(l || node || r)
 from up u join sides s on s.tree = u.tree and s.level = u.level and s.idx = u.idx),
reached as (
 select u.tree, leaf_idx, proof, node, s.idx from up u join subroots s on s.tree = u.tree
 join (select tree, max(level) as level from nodes group by tree) h on h.tree = u.tree and h.level = u.level),
over_(tree, leaf_idx, level, idx, proof, node) as (
 select tree, leaf_idx, 0, idx, proof, node from reached
 union all
 select o.tree, leaf_idx, o.level + 1, o.idx // 8, proof || l || r, sha256(l || node || r)
 from over_ o join top_sides s on s.level = o.level and s.idx = o.idx),
ended as (select * from over_ where level = (select max(level) from tops))
select l.doc_id, l.leaf, s.subroot, t.digest as root, sha256(e.proof) as proof_sha256, e.node as folded_root, e.node = t.digest as verified
from leaves l join ended e on e.tree = l.tree and e.leaf_idx = l.idx join subroots s on s.tree = l.tree
join tops t on t.n = 1"""

QUERIES = {"op11_secret_scan": op11_secret_scan, "op12_lexical_search": op12_lexical_search, "op13_merkle": op13_merkle}
ORACLES = {"op11_secret_scan": OP11_SQL, "op12_lexical_search": OP12_SQL, "op13_merkle": OP13_SQL}
