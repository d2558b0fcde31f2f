import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id as li
from ledgerloom.llm.queries_text import op3_language_id


class Plain:
    """The same code lengths from dictionaries, one symbol at a time."""

    def __init__(self, texts):
        self.seen = {}
        for t in texts:
            data = b"\n" * li.ORDER + t
            for i in range(li.ORDER, len(data)):
                for k in range(li.ORDER + 1):
                    row = self.seen.setdefault(data[i - k : i], {})
                    row[data[i]] = row.get(data[i], 0) + 1

    def bits(self, text):
        data, total = b"\n" * li.ORDER + text, 0.0
        for i in range(li.ORDER, len(data)):
            out = set()
            for k in range(li.ORDER, -1, -1):
                row = {s: n for s, n in self.seen.get(data[i - k : i], {}).items() if s not in out}
                room = sum(row.values()) + len(row)
                if data[i] in row:
                    total -= math.log2(row[data[i]] / room)
                    break
                if row:
                    total -= math.log2(len(row) / room)
                out |= set(row)
            else:
                total -= math.log2(1 / (256 - len(out)))
        return total


def words(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) for _ in range(n))


def test_code_lengths_match_plain_counting(monkeypatch):
    monkeypatch.setattr(li, "CHUNK_BYTES", 50)
    rng = random.Random(1)
    samples = {x: [words(rng, letters, 60).encode() for _ in range(5)] for x, letters in (("a", "abcde"), ("b", "cdefü"))}
    model = li.Model({x: li.Tree.fit(t) for x, t in samples.items()})
    texts = [words(rng, "abcdefgü \n", 40).encode() for _ in range(6)] + [b"a", b"\xff\x00", b"\n\n\n\n\n", b"ab" * 200]
    got = model.totals(texts)
    for j, x in enumerate(model.languages):
        plain = Plain(samples[x])
        for i, t in enumerate(texts):
            assert got[i, j] == pytest.approx(plain.bits(t), rel=1e-5)


def test_probabilities_sum_to_one():
    tree = li.Tree.fit([b"abracadabra", b"abba"])
    for context in (b"abra", b"zzab", b"zzzz", b"\n\n\n\n"):
        import numpy as np

        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert np.exp2(-tree.bits(codes)).sum() == pytest.approx(1.0)


def test_odd_texts_and_no_labels(spark):
    rows = [(1, "hello there friend " * 20, "en"), (2, "guten morgen über " * 20, "de"), (3, None, "en"), (4, "", None), (5, "123 --- !", "de"), (6, "hello friend", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train(docs)
    out = {r.doc_id: r.p for r in docs.select("doc_id", li.predicted(F.col("text"), spark, model).alias("p")).collect()}
    assert [out[i].lang_pred for i in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert out[3].score == 0 and 0.5 < out[1].score <= 1
    nothing = li.train(docs.where("lang = 'xx'"))
    out = docs.select(li.predicted(F.col("text"), spark, nothing).alias("p")).collect()
    assert {r.p.lang_pred for r in out} == {"und"} and len(out) == 6


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([("en", f"word{i} " * 50) for i in range(200)], "lang string, text string")
    model = li.train(docs, sample_bytes=2000)
    assert model.trees[0].counts[0].sum() <= 2000


def test_every_language_is_learned_from_distinct_texts(spark):
    rng = random.Random(4)
    rows = [(f"long{i}", words(rng, "abcdefg", 5000)) for i in range(8)]  # one text of ten samples each
    rows += [(f"copy{i}", f"text {i} " + words(rng, "hijklm", 100)) for i in range(8)] * 60
    rows += [("hot", "the same " * 30)] * 400 + [("hot", f"other {i} " * 5) for i in range(20)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = li.train(docs, sample_bytes=2000)
    assert model.languages == sorted({lang for lang, _ in rows})
    sizes = {x: t.counts[0].sum() for x, t in zip(model.languages, model.trees, strict=True)}
    once = {x: sum(len(t) for t in {t for lang, t in rows if lang == x}) for x in model.languages}
    share = 2000 * li.LANGUAGES // len(once)
    assert sizes == {x: min(share, n) for x, n in once.items()}


def test_ranges_shrink_to_the_sample(spark, monkeypatch):
    monkeypatch.setattr(li, "STEP_BITS", 2)
    docs = spark.createDataFrame([(f"l{i % 3}", f"word{i} " * 50) for i in range(600)], "lang string, text string")
    model = li.train(docs, sample_bytes=2000)
    assert [t.counts[0].sum() for t in model.trees] == [2000] * 3


def test_more_languages_share_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 2)
    docs = spark.createDataFrame([(f"l{i}", f"word{i} " * 50) for i in range(8)], "lang string, text string")
    model = li.train(docs, sample_bytes=200)
    assert [t.counts[0].sum() for t in model.trees] == [50] * 8


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op3_language_id(spark, sf).where("held_out")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = found.join(lang, "doc_id").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
