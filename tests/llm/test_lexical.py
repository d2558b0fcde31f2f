import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import lexical as x


def terms(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", lowered)


def plain(docs, items, places=50):
    """Every document scored for every item."""
    held = [(d, Counter(terms(t))) for d, t, *_ in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, tokens = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * k + 1))) for t, k in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = {}
    for item, own in asked.items():
        scored = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // tokens
            score = sum(weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0))
        for rank, (score, none, d) in enumerate(sorted(scored)[:places], 1):
            out[item, rank] = (None if none else d, -score)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "中文", "Über", "x_y", "a-b"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = []
    for i in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))
        docs.append((i * 7 % 1009 - 300, text.upper() if i % 5 == 0 else text, "clash"))
    docs += [(d + 5000, t, c) for d, t, c in docs[: n // 3]]  # copies: ties
    docs += [(9000, None, ""), (9001, "", ""), (9002, "?!", ""), (None, "w1 w2 w200", ""), (None, "w1 w2 w200", ""), (9003, "w5 " * 3000, "")]
    docs += docs[:3]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(25)]
    return docs, items + [(100, None), (101, "..."), (102, "nowhere"), (103, "w1"), (103, "w7 w8"), (None, "w3 w4")]


@pytest.mark.parametrize(("block", "shard", "query_terms"), [(128, 8192, 10**6), (4, 90, 10**6), (1, 50, 60), (16, 8192, 100)])
def test_search_equals_scoring_all(spark, monkeypatch, block, shard, query_terms):
    monkeypatch.setattr(x, "BLOCK_DOCS", block)
    monkeypatch.setattr(x, "SUMMARY_DOCS", min(block, 4))
    monkeypatch.setattr(x, "SHARD_DOCS", shard)
    docs, items = corpus(block, 400)
    want = plain(docs, items, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = x.search(df, asked, places=20, query_terms=query_terms).collect()
    assert {(r.item_id, r.rank): (r.doc_id, r.score) for r in got} == want and len(got) == len(want)


def test_blocks_are_left_out_by_bounds_only(monkeypatch):
    monkeypatch.setattr(x, "BLOCK_DOCS", 64)
    monkeypatch.setattr(x, "SUMMARY_DOCS", 16)
    rng = np.random.default_rng(4)
    n, kinds = 3000, 40
    known = x.Statistics(n, n * 8, rng.integers(1, 9000, kinds * 10))
    topic = rng.integers(0, kinds, n)
    rows = [np.unique(np.concatenate([topic[i] * 10 + rng.integers(0, 10, 7), rng.integers(0, kinds * 10, 1)])) for i in range(n)]
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    tfs = rng.integers(1, 4, len(flat))
    ids = rng.permutation(n)
    projection = np.random.default_rng(x.SEED).choice([-1.0, 1.0], (kinds * 10, x.SKETCH))
    shard = x.Shard.unpack(x.make_shard(ids, np.zeros(n, bool), np.full(n, 8), sizes, flat, tfs, known, projection).pack())
    ends = np.cumsum(sizes)
    worth = known.weights[flat] * known.impacts(np.full(len(flat), 8), tfs)
    total = fewer = 0
    for k in range(kinds):
        terms = np.unique(np.append(np.arange(k * 10, k * 10 + 5), rng.integers(0, kinds * 10, 2)))
        best = x.Best(10)
        total += x.search_shard(shard, terms, known.weights[terms], best)
        scores = np.add.reduceat(np.where(np.isin(flat, terms), worth, 0), ends - sizes)
        order = np.lexsort((ids, -scores))[:10]
        assert best.scores.tolist() == scores[order].tolist() and best.ids.tolist() == ids[order].tolist()
        fewer += np.count_nonzero(scores)
    assert total < 0.9 * fewer  # some blocks were never scored


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "b c")], "item_id string, text string")
    assert x.search(docs, items).count() == 0
    full = spark.createDataFrame([(1, "b")], "doc_id long, text string")
    assert x.search(full, items.limit(0)).count() == 0
    assert [tuple(r) for r in x.search(full, items).select("item_id", "rank", "doc_id").collect()] == [("a", 1, 1)]


def test_a_kept_index_gives_the_same(spark):
    docs, _ = corpus(7, 200)
    rows = x.forward(spark.createDataFrame(docs, "doc_id long, text string, n string").select("doc_id", "text"), [b"w1", b"w2", b"w50"])
    known = x.statistics(rows, 3)
    items = [(1, np.array([0, 2])), (2, np.array([1]))]
    found = [sorted(x._search(r, items, known, 10**4, "long").collect(), key=repr) for r in (rows, x.index(rows, known))]
    assert found[0] == found[1] and found[0]
