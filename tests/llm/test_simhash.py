import random

import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash as s


def plain_fingerprint(text, k=3):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius):
    """doc -> smallest doc it reaches, comparing every pair."""
    least = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if bin(prints[a] ^ prints[b]).count("1") <= radius and least[b] < least[a]:
                    least[a], changed = least[b], True
    return least


def test_fingerprints(spark):
    texts = ["", None, "one", "Two wORDs", "a b c", "a b c d a b c x", "É e\n\t x y z " * 50, " \x0b\x0c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.fp & (2**64 - 1) for r in df.select("doc_id", s.fingerprint(F.col("text")).alias("fp")).collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket", [0, 3, 1000])
def test_links_match_all_pairs(spark, radius, bucket):
    rng = random.Random(radius)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:40]:
        for _ in range(3):
            for _ in range(rng.randrange(1, 5)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {0, 1, 2**63, 2**64 - 1}
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in s.links(df, radius, bucket=bucket).collect()}
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and bin(a ^ b).count("1") <= radius}
    assert {frozenset(p) for p in got} == want and len(got) == len(want)


def test_components_and_kept_rows(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(200)) for _ in range(12)]
    texts = base + [b + " z" for b in base] + base[:4] + ["", None, " "]
    rows = [(i * 7 % 101, t, "en", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, fp string")
    want = plain_components({d: plain_fingerprint(t) for d, t, *_ in rows}, 2)
    got = s.with_components(docs).collect()
    assert len(got) == len(rows) + 2
    assert all(r.component_id == want[r.doc_id] for r in got)


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(11)
    def text(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for g in range(30):
        words = text(rng.choice([2, 60, 900]))
        copies = [" ".join(words)] * 3 + [" ".join(words[:20] + ["changed"] + words[21:])]
        rows += [(1000 * g + 7 * i + 3, t, "en", "clash", 1) for i, t in enumerate(copies)]
    rows += [(40_000, None, "en", "", 1), (40_001, " ", "en", "", 1), (5, "other words for a repeated id", "en", "", 1)]
    rows += [(50_000, "one id with two texts", "en", "", 1), (50_000, "that are not alike at all", "en", "", 1)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, fp string, content int")
    prints = {(d, t): plain_fingerprint(t) for d, t, *_ in rows}
    nodes = sorted(prints, key=lambda x: (x[0], x[1] or ""))
    numbered = plain_components({i: prints[x] for i, x in enumerate(nodes)}, 2)
    kept = s.deduplicate(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) == len(set(numbered.values()))
    at = {x: i for i, x in enumerate(nodes)}
    assert {numbered[at[x]] for x in got} == set(numbered.values())
    for x in got:  # each is the smallest id of its group
        assert x[0] == min(nodes[i][0] for i in range(len(nodes)) if numbered[i] == numbered[at[x]])


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (None, "a b c d"), (3, "x y z w"), (4, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in s.with_components(docs).collect())
    assert got == [("3", "3"), ("4", "4"), ("None", "None"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in s.deduplicate(docs).collect()) == ["3", "4", "None", "None"]
    assert s.with_components(docs.limit(0)).count() == 0


def test_lookups_are_not_sent_to_the_driver(spark):
    # Spark takes an exploded table for as small as what it was made of, however many rows it has
    prints = s.stage(spark.range(1000).select(F.xxhash64("id").alias("fp")), "fingerprints")
    plan = s.links(prints)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [segment" in plan and "BroadcastHashJoin [segment" not in plan
