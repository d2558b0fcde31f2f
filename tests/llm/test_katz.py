import math
import random
import zlib
from collections import Counter

import pytest

from ledgerloom.llm import katz as k


def words(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\v\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


class Plain:
    """The same model from dictionaries of words."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            seq = words(t) + [None]
            self.uni.update(seq)
            self.bi.update(zip(["<s>"] + seq[:-1], seq, strict=True))
        self.n, self.docs = sum(self.uni.values()), len(texts)
        kinds = [[sum(v == r for v in c.values()) for r in range(1, k.LARGE + 2)] for c in (self.uni, self.bi)]
        self.d1, self.d2 = (k.discounts(x) for x in kinds)
        self.unknown = 1 - sum(self._kept(c, self.d1) for c in self.uni.values()) / self.n if self.n else 1.0
        self.after = {}
        for (h, w), c in self.bi.items():
            self.after.setdefault(h, {})[w] = c

    @staticmethod
    def _kept(c, d):
        return c - k.TAIL if c > k.LARGE else c * d[c - 1]

    def p(self, w):
        return self._kept(self.uni[w], self.d1) / self.n if self.uni[w] else self.unknown

    def given(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.p(w)
        total = sum(seen.values())
        if w in seen:
            return self._kept(seen[w], self.d2) / total
        alpha = (1 - sum(self._kept(c, self.d2) for c in seen.values()) / total) / (1 - sum(map(self.p, seen)))
        return alpha * self.p(w)

    def score(self, text):
        seq = words(text) + [None]
        base = sum(math.log10((self.uni[w] + 1) / (self.n + len(self.uni) + 1)) for w in seq)
        full = sum(math.log10(self.given(h, w)) for h, w in zip(["<s>"] + seq[:-1], seq, strict=True))
        return len(seq), sum(self.uni[w] > 0 for w in seq), base, full


def held(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2


@pytest.fixture(params=["plain", "hot"])
def limits(request, monkeypatch):
    if request.param == "hot":  # many hot words and pairs, more than one partition
        monkeypatch.setattr(k, "HOT", 20)
        monkeypatch.setattr(k, "LEAST_PARTS", 7)
        monkeypatch.setattr(k, "BATCH_BYTES", 500)


def test_scores_match_plain_counting(spark, limits):
    rng = random.Random(9)
    names = [f"w{i}" for i in range(60)] + ["É", "The", "the"]
    rows = []
    for i in range(120):
        draw = [names[min(62, int(rng.expovariate(0.12)))] for _ in range(rng.randrange(0, 60))]
        rows.append((i, " ".join(draw)))
    rows += [(200, None), (201, ""), (202, "\x0b the  THE\n"), (None, "the w1 w2"), (203, "never seen words here w1 w2"), (5, rows[5][1])]
    rows += [(i, "w0 w1 unseen%d w2 the" % i) for i in range(300, 330)]
    assert any(held(d) for d, _ in rows)
    plain = Plain([t for d, t in rows if not held(d)])
    docs = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, kind string, score double").repartition(4)
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.score, r.train_tokens) for r in k.score(docs).collect()))
    want = sorted((str(d), held(d), *plain.score(t), plain.n) for d, t in rows)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:4] == w[:4] and g[6] == w[6]
        assert g[4] == pytest.approx(w[4], abs=1e-6) and g[5] == pytest.approx(w[5], abs=1e-6)
    for h in ("<s>", "w0", "w1", "É"):  # probabilities after a history, unknown words as one class
        assert sum(plain.given(h, w) for w in plain.uni) + plain.given(h, "unknown word") == pytest.approx(1.0)


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if held(i))
    docs = spark.createDataFrame([(out, "a b"), (out, None)], "doc_id long, text string")
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in k.score(docs).collect()] == [(0.0, 0.0, 0, 0)] * 2
    assert k.score(docs.limit(0)).count() == 0


def test_packing():
    import numpy as np

    arrays = [np.arange(5, dtype=np.uint64), np.empty(0), np.array([True, False]), np.array([1.5, -2.0])]
    for a, b in zip(arrays, k.unpack(k.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
