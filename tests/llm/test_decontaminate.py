import random

from ledgerloom.llm import decontaminate as d


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c.isascii() and not c.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += c.lower() if c.isascii() else c
    return out


def plain(docs, items):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1) if n else []:
            wins.setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, names = plain_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                found = wins.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= {str(x) for x in found if x is not None}
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def run(spark, docs, items, **how):
    df = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, item_id string, n int")
    it = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, n_words int")
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r.item_ids)) for r in d.with_hits(df, it, **how).collect()), key=str)


def test_against_plain_search(spark):
    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "É", "zz9", "x"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 11, 30])))) for i in range(20, 40)]
    items = [x for x in items if len(plain_words(x[1])) > 2] + [(41, None), (42, "..."), (43, "É, x!"), (None, "b b b b"), (44, "b b b b")]
    docs = []
    for i in range(60):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))
        if i % 3 == 0:
            text += ". " + (rng.choice(items)[1] or "").upper() + "; tail"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "É\nX"), (3, docs[3][1]), (3, "other words"), (None, items[0][1])]
    assert run(spark, docs, items) == plain(docs, items)


def test_hot_shingles_and_long_text(spark):
    items = [(i, "the of and the of " + f"w{i} the of and the of the of and") for i in range(12)] + [(50, "the " * 25)]
    docs = [(i, "the of and " * 30 + items[i % 13][1] + " the" * 12) for i in range(40)]
    docs.append((99, ("the of and " * 20000) + items[3][1]))
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == [(1, 3, 0, [])]
