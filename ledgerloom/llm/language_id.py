"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``ORDER`` bytes is counted on a bounded sample
of labelled texts and then frozen. A byte is coded in its longest known context, or after
escapes in shorter ones (escape method C, symbols of the longer context excluded); the exact
code lengths of all bytes of a text are summed, and the language with the shortest code wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import stage
from .common import pieces
from .katz import pack, unpack

UNKNOWN = "und"
ORDER = 4
# Bytes of labelled text that a language is learned from, at most, and languages for which that
# much is taken; more share what these may hold, so that all trees together stay small enough for
# every task. The rest of the corpus plays no part in the model, however large it is.
SAMPLE_BYTES = 1_500_000
LANGUAGES = 16
# Bits of the hash that orders the texts of a sample, and bits by which its ranges get smaller.
PLACE_BITS, STEP_BITS = 63, 10
# Bytes scored together, and bounds of the table of known grams: slots as a power of two, bytes.
CHUNK_BYTES = 1 << 20
SLOT_BITS = 20
TABLE_BYTES = 64 << 20
RESULT = "lang_pred string, score double, bits double"
_LETTER = re.compile(r"[^\W\d_]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray, length: int) -> np.ndarray:
    """Codes of the ``length`` bytes that end at each byte of ``data`` from ORDER on."""
    n = len(data) - ORDER
    code = np.zeros(n, np.uint64)
    for back in range(length - 1, -1, -1):
        code = (code << np.uint64(8)) | data[ORDER - back : ORDER - back + n]
    return code


def _padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each behind ORDER line ends, and where each one starts."""
    pad = b"\n" * ORDER
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    return data, np.cumsum(sizes) - sizes


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys`` and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Tree:
    """Frozen counts of one language: for each order the grams, and the contexts they stand in."""

    grams: list[np.ndarray]
    counts: list[np.ndarray]
    contexts: list[np.ndarray]
    totals: list[np.ndarray]
    kinds: list[np.ndarray]
    excluded: list[np.ndarray]

    @classmethod
    def fit(cls, texts: list[bytes]) -> Tree:
        data, starts = _padded(texts)
        inside = np.ones(len(data), bool)
        for i in range(ORDER):
            inside[starts + i] = False
        inside = inside[ORDER:]
        tree = cls([], [], [], [], [], [])
        for order in range(ORDER + 1):
            grams, counts = np.unique(_grams(data, order + 1)[inside], return_counts=True)
            context = grams >> np.uint64(8)
            contexts, first = np.unique(context, return_index=True)
            tree.grams.append(grams)
            tree.counts.append(counts.astype(np.float64))
            tree.contexts.append(contexts)
            tree.totals.append(np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0))
            tree.kinds.append(np.diff(np.append(first, len(grams))).astype(np.float64))
            if order:  # what the next shorter context counts for the symbols known here
                shorter = grams & np.uint64((1 << (8 * order)) - 1)
                seen = tree.counts[order - 1][_find(tree.grams[order - 1], shorter)[0]]
                tree.excluded.append(np.add.reduceat(seen, first) if len(first) else np.zeros(0))
            else:
                tree.excluded.append(np.zeros(len(contexts)))
        return tree

    def pack(self) -> bytes:
        return pack(*(array for f in self.__dataclass_fields__ for array in getattr(self, f)))

    @classmethod
    def unpack(cls, data: bytes) -> Tree:
        arrays = unpack(data)
        orders = ORDER + 1
        return cls(*(arrays[i : i + orders] for i in range(0, len(arrays), orders)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code lengths of the last byte of each gram of ORDER + 1 bytes, given the others."""
        cost = np.zeros(len(codes))
        open_ = np.ones(len(codes), bool)
        less_total, less_kinds = np.zeros(len(codes)), np.zeros(len(codes))
        for order in range(ORDER, -1, -1):
            gram = codes & np.uint64((1 << (8 * (order + 1))) - 1)
            context, known = _find(self.contexts[order], gram >> np.uint64(8))
            at, hit = _find(self.grams[order], gram)
            if not len(self.contexts[order]):
                continue
            total = self.totals[order][context] - less_total
            kinds = self.kinds[order][context] - less_kinds
            room = total + kinds
            coded = open_ & known & hit
            cost[coded] -= np.log2(self.counts[order][at[coded]] / room[coded])
            escaped = open_ & known & ~hit
            paid = escaped & (kinds > 0)
            cost[paid] -= np.log2(kinds[paid] / room[paid])
            open_ &= ~coded
            less_total = np.where(escaped, self.excluded[order][context], 0.0)
            less_kinds = np.where(escaped, self.kinds[order][context], 0.0)
        cost[open_] += np.log2(256 - (len(self.grams[0]) if len(self.contexts[0]) else 0))
        return cost


class Model:
    """All languages, with the code lengths of the known grams in one hash table."""

    def __init__(self, trees: dict[str, Tree]) -> None:
        self.languages = sorted(trees)
        self.trees = [trees[x] for x in self.languages]
        row = 4 * max(1, len(self.trees))
        self.slot_bits = min(SLOT_BITS, (TABLE_BYTES // row).bit_length() - 1)
        grams = np.unique(np.concatenate([np.empty(0, np.uint64), *[t.grams[ORDER] for t in self.trees]]))
        slots = self._slot(grams)
        first = np.unique(slots, return_index=True)[1]  # grams whose slot is taken are scored slowly
        self.keys = np.full(1 << self.slot_bits, np.uint64(2**64 - 1))
        self.keys[slots[first]] = grams[first]
        self.costs = np.zeros((1 << self.slot_bits, len(self.trees)), np.float32)
        if self.trees:
            self.costs[slots[first]] = self._slow(grams[first])

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _MIX) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def _slow(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([t.bits(codes) for t in self.trees], axis=1).astype(np.float32)

    def _lengths(self, data: np.ndarray) -> np.ndarray:
        codes = _grams(data, ORDER + 1)
        slots = self._slot(codes)
        lengths = self.costs[slots]
        missing = np.flatnonzero(self.keys[slots] != codes)
        if len(missing):
            unique, back = np.unique(codes[missing], return_inverse=True)
            lengths[missing] = self._slow(unique)[back]
        return lengths

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language, whole texts of any length."""
        out = np.zeros((len(texts), len(self.trees)))
        pad = b"\n" * ORDER
        at, held = [], []

        def flush() -> None:
            data = np.frombuffer(b"".join(held), np.uint8).astype(np.uint64)
            sizes = np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(sizes) - sizes
            sums = np.add.reduceat(self._lengths(data), self._ends(starts, sizes), axis=0, dtype=np.float64)
            for i, row in zip(at, sums[::2], strict=True):
                out[i] += row

        size = 0
        for i, text in enumerate(texts):
            for begin in range(0, len(text), CHUNK_BYTES):
                part = text[begin : begin + CHUNK_BYTES]
                before = text[max(0, begin - ORDER) : begin]
                held.append(pad[len(before) :] + before + part)
                at.append(i)
                size += len(part)
                if size >= CHUNK_BYTES:
                    flush()
                    at, held, size = [], [], 0
        if held:
            flush()
        return out

    @staticmethod
    def _ends(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Bounds for sums over each text's bytes and, in between, over the next one's padding."""
        bounds = np.empty(2 * len(starts), np.int64)
        bounds[::2] = starts
        bounds[1::2] = starts + sizes - ORDER
        return bounds[:-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float | None]]:
        out: list[tuple[str, float, float | None]] = [(UNKNOWN, 0.0, None)] * len(texts)
        spoken = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        if not self.trees or not spoken:
            return out
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in spoken]
        rates = self.totals(raw) / np.fromiter(map(len, raw), np.float64, len(raw))[:, None]
        best = rates.argmin(axis=1)
        least = rates[np.arange(len(raw)), best]
        scores = 1 / np.exp2(least[:, None] - rates).sum(axis=1)
        for i, b, s, r in zip(spoken, best, scores, least, strict=True):
            out[i] = (self.languages[b], float(s), float(r))
        return out


def _cuts(texts: DataFrame, sample_bytes: int) -> dict[str, int]:
    """For each language the last hash of its sample; ``texts`` are its distinct (lang, place, size).

    Bytes are summed in the order of the hashes, by ever smaller ranges of them, until the range
    in which the sum reaches ``sample_bytes`` holds one text or little more than is needed.
    """
    spark, cuts = texts.sparkSession, {}
    opened: dict[str, tuple[int, int]] | None = None  # begin of the range, bytes before it
    width = PLACE_BITS
    for shift in range(PLACE_BITS - STEP_BITS, -STEP_BITS, -STEP_BITS):
        shift = max(0, shift)
        some = texts
        if opened is not None:
            begins = spark.createDataFrame([(x, lo, lo + (1 << width)) for x, (lo, _) in opened.items()], "lang string, lo long, hi long")
            some = texts.join(F.broadcast(begins), "lang").where("place >= lo and place < hi")
        part = F.shiftrightunsigned("place", shift).alias("part")
        found = some.groupBy("lang", part).agg(F.sum("size").alias("held"), F.count(F.lit(1)).alias("n")).collect()
        following: dict[str, tuple[int, int]] = {}
        taken = {x: before for x, (_, before) in (opened or {}).items()}
        for r in sorted(found, key=lambda r: (r.lang, r.part)):
            before = taken.get(r.lang, 0)
            if before >= sample_bytes:
                continue
            taken[r.lang] = before + r.held
            if taken[r.lang] < sample_bytes or r.n == 1 or r.held <= sample_bytes or not shift:
                cuts[r.lang] = ((r.part + 1) << shift) - 1
            else:
                following[r.lang] = (r.part << shift, before)
        if not following:
            break
        opened, width = following, shift
    return cuts


def train(labelled: DataFrame, *, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from rows (lang, text); rows with a null are left out, each language is sampled.

    The sample of a language takes its distinct texts in the order of a hash, each once, until
    they make up ``sample_bytes``; the last one is cut. Every language has at least one text.
    With more than LANGUAGES languages each is learned from less, so that all of them together
    are bounded. Without rows the model knows no language.
    """
    rows = labelled.select("lang", "text").where("lang is not null and text is not null and text <> ''")
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "text"), 64 - PLACE_BITS)
    texts = stage(
        rows.select("lang", place.alias("place"), F.octet_length("text").alias("size")).groupBy("lang", "place").agg(F.max("size").alias("size")),
        "sample",
    )
    known = texts.select("lang").distinct().count()
    if not known:
        return Model({})
    sample_bytes = max(1, min(sample_bytes, sample_bytes * LANGUAGES // known))
    cuts = _cuts(texts.withColumn("size", F.least("size", F.lit(sample_bytes))), sample_bytes)
    limits = F.broadcast(texts.sparkSession.createDataFrame(list(cuts.items()), "lang string, last long"))
    # a character has a byte at least
    begin = F.substring("text", 1, sample_bytes).alias("text")
    sample = (
        rows.select("lang", place.alias("place"), begin)
        .join(limits, "lang")
        .where("place <= last")
        .groupBy("lang", "place")
        .agg(F.min("text").alias("text"))
    )

    def fit(batch: pa.Table) -> pa.Table:
        taken, left = [], sample_bytes
        for _, text in sorted(zip(batch["place"].to_pylist(), batch["text"].to_pylist(), strict=True)):
            taken.append(text.encode("utf-8", "surrogatepass")[:left])
            left -= len(taken[-1])
            if not left:
                break
        return pa.table({"lang": [batch["lang"][0].as_py()], "tree": pa.array([Tree.fit(taken).pack()], pa.binary())})

    # each tree is fitted in a task of its own; what comes here is bounded with the samples
    fitted = sample.groupBy("lang").applyInArrow(fit, "lang string, tree binary").collect()
    model = Model({r.lang: Tree.unpack(bytes(r.tree)) for r in fitted})
    if len(model.languages) != known:
        raise RuntimeError(f"{known} languages are labelled, {len(model.languages)} were learned")
    return model


def predicted(text: Column, spark: SparkSession, model: Model) -> Column:
    """A struct of lang_pred, score and bits a byte in the predicted language.

    ``score`` compares the languages by code length a byte: 2^-b of the best one over the sum of
    all, so 1 over the number of languages when they tell nothing. A text that is null or has no
    letter is ``und`` with score 0, as is every text when the model knows no language.
    Spark evaluates the column once, also where a filter reads it.
    """
    shared = spark.sparkContext.broadcast(model)

    @pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in pieces(batch):
                yield pd.DataFrame(shared.value.predict(some), columns=["lang_pred", "score", "bits"])

    return run.asNondeterministic()(text)
