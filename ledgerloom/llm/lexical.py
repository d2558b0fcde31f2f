"""Ranked lexical search over posting lists cut into blocks of similar documents.

Documents are dealt into shards as they lie, so that a word's posting list is split however many
documents hold it. In a shard each list is clustered: documents go to the most similar of a few
of its members. A block stores the greatest impact of every term over its documents; the sum of
these over an item's terms bounds the score of every document in the block, so a block is left
out only if that sum is below the score of the item's last place so far. What is left is scored
exactly. All sums are of integers below 2^53, which doubles hold without rounding.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import ascii_lower
from .katz import pack, unpack

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_SQL_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Terms of the items that are searched for together: what every task knows of the queries.
QUERY_TERMS = 200_000
# Documents and postings of a shard, documents of a block on average, and the least that are summarised:
# scoring fewer is cheaper than bounding them.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 19
BLOCK_DOCS = 256
SUMMARY_DOCS = 64
# Dimensions and seed of the random projection by which documents are compared.
SKETCH, SEED = 16, 12
# Blocks of the first wave; each wave takes twice as many as the one before.
WAVE = 4
FORWARD = "doc_id long, n long, terms array<int>, tfs array<int>"


@dataclass
class Statistics:
    """Of all documents: how many hold a term, all their terms, and the weight of each query term."""

    docs: int
    tokens: int
    weights: np.ndarray

    def impacts(self, n: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a weight is multiplied with, for ``tf`` occurrences in documents of ``n`` terms."""
        m = 50 + (50 * n * self.docs) // max(1, self.tokens)
        return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def forward(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Each row's number of terms, and the terms of ``vocabulary`` (numbers, ascending) with their counts."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for text in rows["text"]:
                found = TERM.findall((text.as_py() or b"").lower())
                held = Counter(map(number.get, found))
                held.pop(None, None)
                n.append(len(found))
                own = sorted(held)
                terms += own
                tfs += map(held.__getitem__, own)
                sizes.append(len(terms))
            offsets = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    rows["doc_id"],
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32())),
                ],
                ["doc_id", "n", "terms", "tfs"],
            )

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("text"))
    return raw.mapInArrow(run, FORWARD)


def statistics(rows: DataFrame, terms: int) -> Statistics:
    """Over all rows of ``forward``; a document without terms does not count."""
    docs, tokens = rows.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = (2 * F.lit(docs).cast("double") + 2) / (2 * F.col("df").cast("double") + 1)
    weights = np.zeros(terms, np.int64)
    for r in df.select("term", F.floor(1000 * F.log(ratio)).cast("long").alias("w")).toLocalIterator():
        weights[r.term] = r.w
    return Statistics(docs, tokens or 0, weights)


def _spread(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All positions of the ranges, one range after the other."""
    sizes = stops - starts
    begin = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - begin, sizes)


@dataclass
class Shard:
    """An index over some documents.

    Document d has the terms ``terms[ptr[d]:ptr[d + 1]]`` with their impacts. The blocks of term
    t are ``first[t]`` to ``first[t + 1]``; block b has ``members[held[b]:held[b + 1]]``. Of the
    summaries, term t's column is (``cells``, ``tops``) from ``column[t]`` to ``column[t + 1]``:
    the blocks and their greatest impacts. ``bare`` blocks have none.
    """

    ids: np.ndarray
    missing: np.ndarray
    ptr: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    first: np.ndarray
    held: np.ndarray
    members: np.ndarray
    column: np.ndarray
    cells: np.ndarray
    tops: np.ndarray

    @property
    def bare(self) -> np.ndarray:
        return np.diff(self.held) < SUMMARY_DOCS

    def pack(self) -> bytes:
        """All arrays, the ascending cells of a column as steps."""
        steps = np.diff(self.cells, prepend=self.cells.dtype.type(0))
        return pack(*(steps if f == "cells" else getattr(self, f) for f in self.__dataclass_fields__))

    @classmethod
    def unpack(cls, data: bytes) -> Shard:
        shard = cls(*unpack(data))
        shard.cells = np.cumsum(shard.cells, dtype=shard.cells.dtype)
        return shard


def _clusters(members: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """For each document of a list the most similar of some that stand evenly in it."""
    k = -(-len(members) // BLOCK_DOCS)
    chosen = members[(np.arange(k) * len(members)) // k]
    return (sketches[members] @ sketches[chosen].T).argmax(axis=1)


def make_shard(ids, missing, n, sizes, terms, tfs, known: Statistics, projection: np.ndarray) -> Shard:
    """The index of documents whose terms stand one after the other, ``sizes`` of each."""
    count = len(known.weights)
    ptr = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    impacts = known.impacts(n[doc], tfs.astype(np.int64))
    worth = (impacts * known.weights[terms]).astype(np.float64)
    sketches = np.stack([np.bincount(doc, worth * projection[terms, d], len(sizes)) for d in range(SKETCH)], axis=1)
    sketches /= np.maximum(np.linalg.norm(sketches, axis=1, keepdims=True), 1e-9)
    order = np.argsort(terms, kind="stable")
    term, member = terms[order], doc[order]
    ends = np.searchsorted(term, np.arange(count + 1))
    cluster = np.zeros(len(term), np.int64)
    for t in np.flatnonzero(np.diff(ends) > BLOCK_DOCS):
        cluster[ends[t] : ends[t + 1]] = _clusters(member[ends[t] : ends[t + 1]], sketches)
    again = np.lexsort((cluster, term))
    term, member, cluster = term[again], member[again], cluster[again]
    begins = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(cluster, prepend=-1)) if len(term) else np.empty(0, np.int64)
    held = np.append(begins, len(term)).astype(np.int64)
    first = np.searchsorted(term[begins], np.arange(count + 1))
    greatest = np.zeros(count, np.int64)
    cells, of, tops = ([np.empty(0, np.int32)] for _ in range(3))
    for b in np.flatnonzero(np.diff(held) >= SUMMARY_DOCS):
        own = member[held[b] : held[b + 1]]
        at = _spread(ptr[own], ptr[own + 1])
        np.maximum.at(greatest, terms[at], impacts[at])
        seen = np.flatnonzero(greatest)
        of.append(seen.astype(np.int32))
        tops.append(greatest[seen].astype(np.int32))
        cells.append(np.full(len(seen), b, np.int32))
        greatest[seen] = 0
    of, cells, tops = (np.concatenate(x) for x in (of, cells, tops))
    by_term = np.argsort(of, kind="stable")
    column = np.searchsorted(of[by_term], np.arange(count + 1))
    return Shard(
        ids, missing, ptr, terms.astype(np.int32), impacts.astype(np.int32), first.astype(np.int64), held,
        member.astype(np.int32), column.astype(np.int64), cells[by_term], tops[by_term],
    )


def _shards(batches: Iterator[pa.RecordBatch], known: Statistics) -> Iterator[Shard]:
    """Shards over neighbouring rows of ``forward``, one after the other."""
    projection = np.random.default_rng(SEED).choice([-1.0, 1.0], (len(known.weights), SKETCH))

    def made(some: list[pa.RecordBatch]) -> Shard:
        whole = pa.Table.from_batches(some).combine_chunks()
        ids, terms, tfs = whole["doc_id"], whole["terms"].combine_chunks(), whole["tfs"].combine_chunks()
        return make_shard(
            ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(), whole["n"].to_numpy(),
            np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tfs.flatten().to_numpy(), known, projection,
        )

    waiting: list[pa.RecordBatch] = []
    docs = postings = 0
    for batch in batches:
        sizes, begin = np.diff(batch["terms"].offsets.to_numpy()), 0
        for at, size in enumerate(sizes.tolist(), 1):
            docs, postings = docs + 1, postings + size
            if docs == SHARD_DOCS or postings >= SHARD_POSTINGS:
                yield made([*waiting, batch.slice(begin, at - begin)])
                waiting, begin, docs, postings = [], at, 0, 0
        if begin < len(sizes):
            waiting.append(batch.slice(begin))
    if waiting:
        yield made(waiting)


def index(rows: DataFrame, known: Statistics) -> DataFrame:
    """(shard): packed shards over all rows of ``forward`` that hold a query term, to be kept and searched again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, known):
            yield pa.RecordBatch.from_arrays([pa.array([shard.pack()], pa.binary())], ["shard"])

    return rows.where(F.size("terms") > 0).mapInArrow(run, "shard binary")


class Best:
    """The best documents of one item so far: score, then smaller id, rows without id last."""

    def __init__(self, places: int) -> None:
        self.places = places
        self.scores, self.ids, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """What a score must reach to take a place."""
        return int(self.scores[-1]) if len(self.scores) == self.places else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids, missing = (
                np.concatenate([old, new[good]])
                for old, new in ((self.scores, scores), (self.ids, ids), (self.missing, missing))
            )
            order = np.lexsort((ids, missing, -scores))[: self.places]
            self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def search_shard(shard: Shard, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Bring ``best`` up to date for an item of ``terms`` with their ``weights``; returns documents scored."""
    blocks = _spread(shard.first[terms], shard.first[terms + 1])
    if not len(blocks):
        return 0
    at = _spread(shard.column[terms], shard.column[terms + 1])
    worth = np.repeat(weights, shard.column[terms + 1] - shard.column[terms]).astype(np.float64)
    bound = np.bincount(shard.cells[at], worth * shard.tops[at], len(shard.held) - 1).astype(np.float64)
    bound[shard.bare] = np.inf
    order = np.argsort(-bound[blocks], kind="stable")
    blocks = blocks[order]
    bound = bound[blocks]
    value = np.zeros(len(shard.first) - 1, np.int64)
    value[terms] = weights
    seen = np.zeros(len(shard.ids), bool)
    done, wave, scored = 0, max(WAVE, int(np.isinf(bound).sum())), 0
    while done < (stop := int(np.searchsorted(-bound, -float(best.least), side="right"))):
        some = blocks[done : min(done + wave, stop)]
        docs = np.unique(shard.members[_spread(shard.held[some], shard.held[some + 1])])
        docs = docs[~seen[docs]]
        seen[docs] = True
        if len(docs):
            own = _spread(shard.ptr[docs], shard.ptr[docs + 1])
            starts = np.cumsum(shard.ptr[docs + 1] - shard.ptr[docs]) - (shard.ptr[docs + 1] - shard.ptr[docs])
            scores = np.add.reduceat(value[shard.terms[own]] * shard.impacts[own], starts)
            best.add(scores, shard.ids[docs], shard.missing[docs])
            scored += len(docs)
        done, wave = done + len(some), 2 * wave
    return scored


def _search(rows: DataFrame, items: list[tuple[object, np.ndarray]], known: Statistics, places: int, kind: str) -> DataFrame:
    """Each task's best documents of every item (item_id, doc_id, score).

    ``rows`` are those of ``forward`` or of ``index``. Shards of the former are dropped once they
    are searched: their summaries are larger than what they are made of.
    """
    packed = rows.columns == ["shard"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(t[known.weights[t] > 0], Best(places)) for _, t in items]
        kept = (Shard.unpack(data.as_py()) for batch in batches for data in batch["shard"])
        for shard in kept if packed else _shards(batches, known):
            for terms, best in asked:
                search_shard(shard, terms, known.weights[terms], best)
        sizes = [len(best.ids) for _, best in asked]
        if sum(sizes):
            ids = [None if m else i for _, best in asked for i, m in zip(best.ids.tolist(), best.missing, strict=True)]
            scores = np.concatenate([best.scores for _, best in asked])
            names = [item for (item, _), size in zip(items, sizes, strict=True) for _ in range(size)]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item_id", "doc_id", "score"])

    held = rows if packed else rows.where(F.size("terms") > 0)
    return held.mapInArrow(run, f"item_id {kind}, doc_id long, score long")


def asked_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): each item's distinct terms; rows of one item_id are one item."""
    words = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(_SQL_TERM), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def search(docs: DataFrame, items: DataFrame, *, places: int = 50, query_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``places`` best rows of ``docs`` for each item, scores above 0.

    Equal scores rank by doc_id, rows without doc_id last; repeated rows are ranked one by one. A
    null or empty text holds no term; items without terms and an empty table give no rows. Other
    columns are not read. Items are searched for in groups of about ``query_terms`` terms, over
    an index of all rows for each group, with the same results for any number.
    """
    spark = docs.sparkSession
    terms = stage(asked_terms(items), "items")
    many = terms.count()
    groups = max(1, -(-many // query_terms))
    kind = items.schema["item_id"].dataType.simpleString()
    found = None
    for group in range(groups):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == group)
        asked = mine.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
        vocabulary = sorted({t.encode("utf-8", "surrogatepass") for r in asked for t in r.terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        coded = [(r.item_id, np.array(sorted(number[t.encode("utf-8", "surrogatepass")] for t in r.terms), np.int64)) for r in asked]
        rows = stage(forward(docs, vocabulary), "forward")
        known = statistics(rows, len(vocabulary))
        part = _search(rows, coded, known, places, kind)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    place = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= places)
    return ranked.select("item_id", "rank", "doc_id", "score")
