import random
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import winnow as w

def mixed(value):
    return xxhash.xxh64(struct.pack("<q", value), seed=42).intdigest() % 2**32

def signed(h):
    return h - 2**64 if h >= 2**63 else h

def hashed(x):
    return xxhash.xxh64(x.encode(), seed=42).intdigest()

def winnowed(hashes, k, window):
    grams = []
    for i in range(max(len(hashes) - k + 1, min(1, len(hashes)))):
        rolled = 0
        for h in hashes[i : i + k]:
            rolled = (rolled * w.BASE + h) % w.PRIME
        grams.append(mixed(rolled))
    out = []
    for i in range(max(len(grams) - window + 1, min(1, len(grams)))):
        part = grams[i : i + window]
        at = max(j for j, g in enumerate(part) if g == min(part)) + i
        if (grams[at], at) not in out:
            out.append((grams[at], at))
    return out

def plain(text, k=w.KGRAM, window=w.WINDOW):
    """(hash, position) of the rightmost least hash of every window, of words and then of characters."""
    found = [x for x in re.split("[\\x20\\x09-\\x0D]+", text or "") if x]
    out = winnowed([signed(hashed(x)) % w.PRIME for x in found], k, window)
    spoken = " ".join(found)
    if len(spoken) >= w.CHAR_KGRAM and (len(found) < w.FEW_WORDS or len(spoken) > w.LONG_WORDS * len(found)):
        # two columns are hashed one after the other, the first seeds the second
        chars = [signed(xxhash.xxh64(c.encode(), seed=xxhash.xxh64(b"char", seed=42).intdigest()).intdigest()) % w.PRIME for c in spoken]
        out += winnowed(chars, w.CHAR_KGRAM, w.CHAR_WINDOW)
    return out

def unpacked(packed):
    return [(x >> w.POSITION_BITS, w.LAST - (x & w.LAST)) for x in packed]

def plain_next(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    return {(d, t or ""): order[(i + 1) % len(order)][1] or "" for i, (d, t) in enumerate(order)}

def jaccard(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0

def test_choice_of_hashes(spark):
    rng = random.Random(4)
    texts = ["中文" * 40, "x" * 500, "ab cd efg", "1234567", "12345678", ("長" * 40 + " ") * 30, "", None, "one", "a b c d", "a b c d e", "x " * 300, "é\tü\n\n a\x0bb  c d e f g h i j k l m n"]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (11, 12, 13, 60, 400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in df.select("doc_id", w.chosen(F.col("text")).alias("f")).collect():
        assert unpacked(r.f) == plain(texts[r.doc_id])

def test_match_guarantee(spark):
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(w.KGRAM + w.WINDOW - 1)]
    a = " ".join([f"a{rng.random()}" for _ in range(50)] + shared + ["q"])
    b = " ".join([f"b{rng.random()}" for _ in range(31)] + shared + [f"b{rng.random()}" for _ in range(9)])
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    one, two = (set(r.h) for r in df.select(w.hashes_of(w.chosen(F.col("text"))).alias("h")).collect())
    assert one & two

@pytest.mark.parametrize(
    ("bits", "ids"), [(3, range(40)), (10, [i * 9973 - 10**5 for i in range(40)]), (20, [-(2**50), 5, 2**40]), (3, [None, 3, None, 9])]
    + [(10, [-1, 1, 0]), (10, [-(2**63), 2**63 - 1, 0, None]), (8, [-5, None, 4, 2**62, -(2**62)]), (10, [None, None])]
)
def test_edits_and_likeness(spark, monkeypatch, bits, ids):
    monkeypatch.setattr(w, "BLOCK_BITS", bits)
    rng = random.Random(8)
    rows = [(d, " ".join(f"w{rng.randrange(30)}é" for _ in range(rng.randrange(1, 60))) + f" {i}") for i, d in enumerate(ids)]
    rows[1] = (rows[1][0], None)
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, block string")
    following = plain_next(rows)
    out = w.with_edits(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        after = following[(r.doc_id, r.text)]
        half = len(r.text) // 2
        edited = r.text[: len(r.text) - half] + after[:half]
        assert r.edited_text == edited
        assert unpacked(r.fingerprint) == plain(r.text) and unpacked(r.edited_fingerprint) == plain(edited)
        assert r.near_edited == pytest.approx(jaccard(plain(r.text), plain(edited)))
        assert r.near_next == pytest.approx(jaccard(plain(r.text), plain(after)))


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d"), (2, "c d")], "doc_id long, text string")
    got = sorted((r.doc_id, r.next_text) for r in w.with_next(docs).collect())
    assert got == [(1, "c d"), (2, "a b"), (2, "c d")]


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string")
    (r,) = w.with_edits(docs).collect()
    assert r.edited_text == "a b c a b c"[: len(r.text) - len(r.text) // 2] + "a b c d e f"[: len(r.text) // 2] and r.near_next == 1.0
    assert w.with_edits(docs.limit(0)).count() == 0
    nobody = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in w.with_next(nobody).collect()} == {("a", "b"), ("b", "a")}


def test_spaceless_and_short_texts_share_hashes(spark):
    rng = random.Random(2)
    def signs(n):
        return "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    shared = signs(w.CHAR_KGRAM + w.CHAR_WINDOW - 1)
    short = "one little text of nine words and no more"
    pairs = [(signs(90) + shared + signs(41), signs(7) + shared), (short, short[: len(short) // 2] + "something else follows")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select(w.hashes_of(w.chosen(F.col("a"))).alias("a"), w.hashes_of(w.chosen(F.col("b"))).alias("b")).collect():
        assert set(r.a) & set(r.b)
