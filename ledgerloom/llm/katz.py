"""Word bigram language model with Katz backoff.

Counts are discounted by Good and Turing, the mass that a history loses goes to the words never
seen after it, in proportion to their own probability, and the weight of that is normalised
exactly. A text's probability is the sum over its tokens of

    log p(w|h) = log c*(h,w) - log c(h)                  if h w was seen in training,
                 log alpha(h) + log p(w)                 if only h was,
                 log p(w)                                else,

with the same discounts for p(w) and one class for all unknown words. Tokens are known by the
64-bit hash of their bytes. Neither texts nor a vocabulary are sent around: a first pass counts
words, a second sends each batch of documents' distinct bigrams, packed, to the partition of
their last word, where counts and the texts' partial sums meet; a third normalises histories
and evaluates the backed-off tokens. The tables between the passes are partitioned by kind.
Words and pairs of more than 1/HOT of all tokens, at most HOT of each, are counted beforehand
and known to all tasks, so that no partition gets them whole.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import doc_remainder

# Counts up to LARGE are discounted by Good and Turing; larger ones give up TAIL of a count, so
# that every history keeps some mass.
LARGE = 5
TAIL = 0.01
HOT = 1024
# Tokens of one partition of bigrams, on average, and partitions at least.
PART_TOKENS = 2_000_000
LEAST_PARTS = 32
# Text whose tokens are sorted and sent together.
BATCH_BYTES = 6 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(xxhash.xxh64_intdigest(b" end"))
START = np.uint64(xxhash.xxh64_intdigest(b" start"))
PACKED = "kind string, part long, seq long, data binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of equal significance together, compressed."""
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"" for a in arrays)
    return struct.pack("<I", len(head)) + head + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpack(data: bytes) -> list[np.ndarray]:
    n = struct.unpack_from("<I", data)[0]
    kinds = [(np.dtype(d), size) for d, size in json.loads(data[4 : 4 + n])]
    total = sum(d.itemsize * size for d, size in kinds)
    body = pa.decompress(data[4 + n :], total, "zstd", asbytes=True) if total else b""
    out, at = [], 0
    for dtype, size in kinds:
        planes = np.frombuffer(body, np.uint8, dtype.itemsize * size, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += dtype.itemsize * size
    return out


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=np.uint64(0))


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32)


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and an end, and how many each text has."""
    found = []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").lower().split()
        found.append(np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(0)), np.uint64, len(own)))
    sizes = np.array([len(own) + 1 for own in found], np.int64)
    out = np.full(int(sizes.sum()), END)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(sizes) - 1] = False
    if found:
        out[inside] = np.concatenate(found)
    return out, sizes


def histories(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return before


def pair_key(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = h * _A + (w ^ (w >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(31))


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys * _A) >> np.uint64(24)).astype(np.int64) % parts


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``wanted`` in sorted ``keys``, zero where missing, and what is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    there = keys[at] == wanted
    return np.where(there, values[at], 0), there


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of each value."""
    unique, back = np.unique(keys, return_inverse=True)
    return (unique, *[np.bincount(back, v, len(unique)) for v in values])


def discounts(seen: list[int]) -> np.ndarray:
    """Factors for counts 1 to LARGE from the numbers of kinds seen 1 to LARGE + 1 times.

    Katz's formula; where it gives no factor between 0 and 1 (few data), half a count is taken.
    """
    out = np.array([(r - 0.5) / r for r in range(1, LARGE + 1)])
    if seen[0]:
        common = (LARGE + 1) * seen[LARGE] / seen[0]
        for r in range(1, LARGE + 1):
            if seen[r - 1] and common != 1:
                factor = ((r + 1) * seen[r] / (r * seen[r - 1]) - common) / (1 - common)
                if 0 < factor < 1:
                    out[r - 1] = factor
    return out


@dataclass
class Words:
    """What all tasks know of the words: totals, discounts, and the hot words and pairs."""

    total: int
    kinds: int
    docs: int
    factors: np.ndarray
    unknown: float
    parts: int
    hot: np.ndarray
    hot_counts: np.ndarray
    pairs: np.ndarray
    pair_h: np.ndarray
    pair_w: np.ndarray
    pair_counts: np.ndarray

    def probability(self, counts: np.ndarray) -> np.ndarray:
        """p(w) of words by training count; of the class of unknown words for zero."""
        if not self.total:
            return np.full(len(counts), self.unknown)
        own = np.where(counts > LARGE, counts - TAIL, counts * self.factors[np.clip(counts, 1, LARGE).astype(int) - 1])
        return np.where(counts > 0, own / self.total, self.unknown)


def _batches(docs: DataFrame, use, schema: str) -> DataFrame:
    """``use`` over (batch number, doc_id, held_out, text) of about BATCH_BYTES of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 24
        for rows in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(rows["text"]), 0))
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
                if b > a:
                    part = rows.slice(a, b - a)
                    held = np.array(part["held_out"].to_pylist(), bool)
                    yield from use(seq, part["doc_id"], held, part["text"].to_pylist())
                    seq += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)


def _rows(schema: str, **columns) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [pa.field(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in fields], schema=pa.schema(fields))


def count_words(docs: DataFrame) -> DataFrame:
    """(w, n): hash and count of every token of the training documents."""

    def use(_: int, __, held: np.ndarray, texts: list) -> Iterator[pa.RecordBatch]:
        hashes, ___ = tokens([t for t, h in zip(texts, held, strict=True) if not h])
        w, n = np.unique(hashes, return_counts=True)
        yield _rows("w long, n long", w=w.view(np.int64), n=n)

    return _batches(docs, use, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _hot_pairs(docs: DataFrame, hot: np.ndarray, least: float) -> list:
    """Pairs (h, w, n) of hot words (or the start) that are hot themselves."""
    ends = np.sort(np.append(hot, START))

    def use(_: int, __, held: np.ndarray, texts: list) -> Iterator[pa.RecordBatch]:
        w, sizes = tokens([t for t, h in zip(texts, held, strict=True) if not h])
        h = histories(w, sizes)
        both = _lookup(ends, ends, w)[1] & _lookup(ends, ends, h)[1]
        key, first, n = np.unique(pair_key(h[both], w[both]), return_index=True, return_counts=True)
        yield _rows("h long, w long, n long", h=h[both][first].view(np.int64), w=w[both][first].view(np.int64), n=n)

    counted = _batches(docs, use, "h long, w long, n long").groupBy("h", "w").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > least).collect()


def learn_words(docs: DataFrame) -> tuple[Words, DataFrame]:
    """The words of the training documents, and their table (w, n)."""
    table = stage(count_words(docs), "unigrams")
    seen = [F.sum((F.col("n") == r).cast("long")) for r in range(1, LARGE + 2)]
    large = F.col("n") > LARGE
    total, kinds, many, mass, *few = table.agg(
        F.sum("n"), F.count(F.lit(1)), F.sum(large.cast("long")), F.sum(F.when(large, F.col("n"))), *seen
    ).first()
    total, kinds, few = total or 0, kinds or 0, [x or 0 for x in few]
    training = docs.where("not held_out").count()
    factors = discounts(few)
    known = (mass or 0) - TAIL * (many or 0) + sum(r * n * f for r, n, f in zip(range(1, LARGE + 1), few, factors, strict=False))
    unknown = 1 - known / total if total else 1.0
    # more than total/HOT tokens each: fewer than HOT words, and fewer than HOT pairs
    hot = table.where(F.col("n") > max(total / HOT, LARGE + 1)).collect()
    order = np.argsort(np.array([r.w for r in hot], np.int64).view(np.uint64))
    words = np.array([r.w for r in hot], np.int64).view(np.uint64)[order]
    counts = np.array([r.n for r in hot], np.int64)[order]
    pairs = _hot_pairs(docs, words, max(total / HOT, LARGE + 1)) if len(words) else []
    h, w = (np.array([r[i] for r in pairs], np.int64).view(np.uint64) for i in (0, 1))
    keys = pair_key(h, w)
    at = np.argsort(keys)
    parts = max(LEAST_PARTS, -(-total // PART_TOKENS))
    n = np.array([r[2] for r in pairs], np.int64)
    return Words(total, kinds, training, factors, unknown, parts, words, counts, keys[at], h[at], w[at], n[at]), table


def _send(words: Words):
    """The second pass: a batch's distinct bigrams, packed for the partition of each."""

    def use(seq: int, ids, held: np.ndarray, texts: list) -> Iterator[pa.RecordBatch]:
        w, sizes = tokens(texts)
        h = histories(w, sizes)
        doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
        key = pair_key(h, w)
        count, hot_pair = _lookup(words.pairs, words.pair_counts, key)
        # tokens of hot pairs are settled here
        word_count = _lookup(words.hot, words.hot_counts, w[hot_pair])[0]
        back = np.where(w[hot_pair] == END, 0.0, np.log10(np.maximum(word_count, 1)))
        settled = [
            np.bincount(doc[hot_pair], v, len(texts))
            for v in (np.log10(count[hot_pair] - TAIL) - back, np.log10(word_count + 1.0), np.ones(len(back)))
        ]
        missing = np.array(ids.is_null())
        id_values = np.array([0 if x is None else x for x in ids.to_pylist()], np.int64)
        rows = [("docs", seq % words.parts, pack(id_values, missing, held, sizes, *settled))]
        w, h, doc, key = (x[~hot_pair] for x in (w, h, doc, key))
        pairs, first, at = np.unique(key, return_index=True, return_inverse=True)
        pw, ph = w[first], h[first]
        part = np.where(_lookup(words.hot, words.hot_counts, pw)[1], _part(pairs, words.parts), _part(pw, words.parts))
        order = np.lexsort((ph, pw, part))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        entries, times = np.unique(rank[at] * len(texts) + doc, return_counts=True)
        entry_pair, entry_doc = entries // len(texts), entries % len(texts)
        trained = np.bincount(entry_pair, times * ~held[entry_doc], len(order)).astype(np.int64)
        held_by = np.bincount(entry_pair, minlength=len(order))
        pw, ph, part = pw[order], ph[order], part[order]
        bounds = np.searchsorted(part, np.arange(words.parts + 1))
        until = np.concatenate([[0], np.cumsum(held_by)])
        for p in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[p], bounds[p + 1]
            own_w, runs = np.unique(pw[a:b], return_counts=True)
            own_h, codes = np.unique(ph[a:b], return_inverse=True)
            some = slice(until[a], until[b])
            data = pack(
                _steps(own_w), _small(runs), _steps(own_h), _small(codes), _small(trained[a:b]), _small(held_by[a:b]),
                _small(entry_doc[some]), _small(times[some]), np.array([len(texts)], np.uint32),
            )
            rows.append(("pairs", int(p), data))
        kind, part_of, data = zip(*rows, strict=True)
        yield _rows(PACKED, kind=kind, part=part_of, seq=[seq] * len(rows), data=data)

    return use


def _opened(data: bytes) -> tuple[np.ndarray, ...]:
    own_w, runs, own_h, codes, trained, held_by, docs, times, size = unpack(data)
    return np.repeat(np.cumsum(own_w), runs), np.cumsum(own_h)[codes], trained, held_by, docs, times, int(size[0])


def _meet(words: Words):
    """In a partition of bigrams: their counts, partial sums of texts, statistics of histories."""

    def use(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["seq"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda r: (r[0], r[2]))
        out = [("docs", seq, 0, data) for kind, _, seq, data in rows if kind == "docs"]
        part = next((p for kind, p, *_ in rows if kind == "pairs"), None)
        sent = [(seq, *_opened(data)) for kind, _, seq, data in rows if kind == "pairs"]
        del rows
        if sent:
            w, h, trained = (np.concatenate([s[i] for s in sent]) for i in (1, 2, 3))
            # what is gathered is not kept batch by batch as well
            sent = [(seq, len(own), *rest) for seq, own, _, __, *rest in sent]
            pairs, first, at = np.unique(pair_key(h, w), return_index=True, return_inverse=True)
            count = np.bincount(at, trained, len(pairs))
            pw, ph = w[first], h[first]
            del w, h, trained, first
            rare, rare_at = np.unique(pw, return_inverse=True)
            word_count = np.bincount(rare_at, count, len(rare))
            hot_count, is_hot = _lookup(words.hot, words.hot_counts, rare)
            word_count = np.where(is_hot, hot_count, word_count)[rare_at]
            chance = words.probability(word_count)
            seen = count > 0
            bits = np.where(seen, np.log10(np.where(count > LARGE, count - TAIL, np.maximum(count, 1))), np.log10(chance))
            bits -= np.where((pw == END) | (word_count == 0), 0.0, np.log10(np.maximum(word_count, 1)))
            base = np.log10(word_count + 1)
            gaps = []
            start = 0
            for seq, n_pairs, held_by, docs, times, size in sent:
                mine = np.repeat(at[start : start + n_pairs], held_by)
                start += n_pairs
                sums = [np.bincount(docs, times * v[mine], size) for v in (bits, base, word_count > 0)]
                low = [_small(np.bincount(docs, times * (count[mine] == r), size)) for r in range(1, LARGE + 1)]
                out.append(("sums", seq, part, pack(*sums, *low)))
                open_ = ~seen[mine]
                if open_.any():
                    gaps.append((ph[mine[open_]], np.full(open_.sum(), seq, np.int64), docs[open_], times[open_]))
            h_seen = ph[seen]
            few = [(count[seen] == r).astype(np.float64) for r in range(1, LARGE + 1)]
            many = np.where(count[seen] > LARGE, count[seen], 0)
            stats = _sums(h_seen, many, (many > 0).astype(np.float64), chance[seen], *few)
            out += [("seen", r, int(np.sum(count == r)), b"") for r in range(1, LARGE + 2)]
            place = _part(stats[0], words.parts)
            for p in np.unique(place):
                mine = place == p
                out.append(("histories", int(p), part, pack(_steps(stats[0][mine]), *[s[mine] for s in stats[1:]])))
            if gaps:
                gh, gseq, gdoc, gtimes = (np.concatenate(x) for x in zip(*gaps, strict=True))
                order = np.argsort(gh, kind="stable")
                gh, gseq, gdoc, gtimes = gh[order], gseq[order], gdoc[order], gtimes[order]
                place = _part(gh, words.parts)
                for p in np.unique(place):
                    mine = place == p
                    out.append(("gaps", int(p), part, pack(_steps(gh[mine]), gseq[mine], gdoc[mine], gtimes[mine])))
        kind, key, source, data = zip(*out, strict=True)
        return pa.Table.from_batches([_rows(PACKED, kind=kind, part=key, seq=source, data=data)])

    return use


def weights(words: Words, factors: np.ndarray, part: int, stats: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """(h, c(h), alpha(h)) of a partition of histories, exactly normalised."""
    mine = _part(words.pair_h, words.parts) == part
    hot_stats = [words.pair_h[mine], words.pair_counts[mine].astype(np.float64), np.ones(mine.sum()), words.probability(_lookup(words.hot, words.hot_counts, words.pair_w[mine])[0])]
    hot_stats += [np.zeros(mine.sum())] * LARGE
    columns = [np.concatenate(x) for x in zip(hot_stats, *stats, strict=True)]
    h, many, kinds, lower, *few = _sums(*columns)
    count = many + sum(r * n for r, n in zip(range(1, LARGE + 1), few, strict=True))
    kept = many - TAIL * kinds + sum(r * f * n for r, f, n in zip(range(1, LARGE + 1), factors, few, strict=True))
    return h, count, (1 - kept / count) / (1 - lower)


def _back_off(words: Words, factors: np.ndarray):
    """In a partition of histories: their weights, and the backed-off tokens' share of each text."""

    def use(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["kind"].to_pylist(), table["part"].to_pylist(), table["seq"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda r: (r[0], r[2]))
        part = rows[0][1]
        stats = []
        for kind, _, __, data in rows:
            if kind == "histories":
                steps, *rest = unpack(data)
                stats.append([np.cumsum(steps), *rest])
        h, count, alpha = weights(words, factors, part, stats)
        out = []
        found = [unpack(data) for kind, _, __, data in rows if kind == "gaps"]
        if found:
            gh = np.concatenate([np.cumsum(f[0]) for f in found])
            seq, doc, times = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
            if len(h):
                at = np.minimum(np.searchsorted(h, gh), len(h) - 1)
                share = np.where(h[at] == gh, np.log10(alpha[at]) + np.log10(count[at]), 0.0)
            else:
                share = np.zeros(len(gh))
            for s in np.unique(seq):
                mine = seq == s
                docs, sums = _sums(doc[mine].astype(np.int64), share[mine] * times[mine])
                out.append(("back", int(s), part, pack(docs, sums)))
        out.append(("weights", part, part, pack(_steps(h), count, alpha)))
        kind, key, source, data = zip(*out, strict=True)
        return pa.Table.from_batches([_rows(PACKED, kind=kind, part=key, seq=source, data=data)])

    return use


def _finish(words: Words, factors: np.ndarray):
    """All sums of a batch of documents, put together."""

    def use(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["kind"].to_pylist(), table["seq"].to_pylist(), table["data"].to_pylist(), strict=True), key=lambda r: r[:2])
        ids, missing, held, sizes, bits, base, known = unpack(next(d for k, _, d in rows if k == "docs"))
        bits, base, known = (x.astype(np.float64) for x in (bits, base, known))
        for kind, _, data in rows:
            if kind == "sums":
                more_bits, more_base, more_known, *low = unpack(data)
                bits += more_bits + sum(n * np.log10(f) for n, f in zip(low, factors, strict=True))
                base += more_base
                known += more_known
            elif kind == "back":
                docs, sums = unpack(data)
                bits[docs] += sums
        if words.docs:
            bits -= np.log10(words.docs)
        base -= sizes * np.log10(words.total + words.kinds + 1)
        return pa.Table.from_batches(
            [
                _rows(
                    SCORES, doc_id=[None if m else int(i) for i, m in zip(ids, missing, strict=True)], held_out=held,
                    n_tokens=sizes, n_known=np.rint(known).astype(np.int64), base_score=base, score=bits,
                )
            ]
        )

    return use


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(doc_id as text) leaves ``remainder`` are held out of the training. A null
    text counts as empty (one token, its end); a null doc_id is not held out; repeated rows are
    trained on and scored one by one. Without training rows every word is unknown and all
    scores are 0. Of ``docs`` only doc_id and text are read.
    """
    held = F.coalesce(doc_remainder(F.col("doc_id"), modulus) == remainder, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    words, _ = learn_words(rows)
    sent = _batches(rows, _send(words), PACKED)
    dealt = sent.repartition(words.parts, "part")  # tasks grow in number with the groups
    met = stage(dealt.groupBy("part").applyInArrow(_meet(words), PACKED), "bigrams")
    seen = {r.part: r.n for r in met.where("kind = 'seen'").groupBy("part").agg(F.sum("seq").alias("n")).collect()}
    factors = discounts([seen.get(r, 0) for r in range(1, LARGE + 2)])
    back = stage(
        met.where("kind in ('histories', 'gaps')").repartition(words.parts, "part").groupBy("part").applyInArrow(_back_off(words, factors), PACKED),
        "weights",
    )
    sums = met.where("kind in ('docs', 'sums')").unionByName(back.where("kind = 'back'"))
    out = sums.groupBy("part").applyInArrow(_finish(words, factors), SCORES)
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(words.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
