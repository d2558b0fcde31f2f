"""Queries over documents and benchmark items."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, katz, language_id, sharding, simhash, winnow
from .common import doc_remainder, table

TOKENIZER = "byte_bpe_50k.tiktoken"


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(doc_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out)
    model = language_id.train(docs.where("not held_out"))
    found = docs.select("doc_id", "held_out", language_id.predicted(F.col("text"), spark, model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.with_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        winnow.written(F.col("fingerprint")).alias("fingerprint"),
        winnow.written(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.with_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP7_SQL = """with w as (
 select doc_id, list_filter(regexp_split_to_array(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
iw as (
 select item_id, list_filter(regexp_split_to_array(
   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
   '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
wins as (
 select distinct item_id, least(len(w), 10) as n,
  array_to_string(w[pos : pos + least(len(w), 10) - 1], ' ') as body
 from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as pos from iw where len(w) > 0)),
lens as (select distinct n from wins),
spots as (
 select doc_id, n, pos, array_to_string(w[pos : pos + n - 1], ' ') as body
 from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as pos from w, lens where len(w) >= n)),
hits as (select doc_id, pos, s.n, item_id from spots s join wins using (n, body)),
covered as (
 select doc_id, count(distinct word) as n_hit
 from (select doc_id, unnest(range(pos, pos + n)) as word from (select distinct doc_id, pos, n from hits)) group by doc_id),
named as (
 select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
 from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select w.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
 cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
 coalesce(n_hit, 0) > 0 as contaminated
from w left join covered using (doc_id) left join named using (doc_id)"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(TOKENIZER)
    code = bpe.coded(F.col("text"), path, public_tokenizers.PATTERN, digests=True)
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code")).select("doc_id", "code.*")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


QUERIES = {
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op6_winnow": op6_winnow,
    "op7_decontaminate": op7_decontaminate,
    "op8_bpe": op8_bpe,
    "op10_katz": op10_katz,
}
ORACLES = {"op7_decontaminate": OP7_SQL}
