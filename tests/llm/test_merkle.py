import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import merkle as m


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def up(level):
    return [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]


def plain_tree(leaves):
    """The root, and for each leaf the siblings level by level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append(up(levels[-1]))
    paths = []
    for at in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            begin = at // 8 * 8
            path.append(("".join(level[begin:at]), "".join(level[at + 1 : begin + 8])))
            at //= 8
        paths.append(path)
    return levels[-1][0], paths


def plain(rows):
    groups = defaultdict(list)
    for doc, group, leaf in rows:
        groups[group].append((doc is not None, doc or 0, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = plain_tree([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops, strict=True):
        sub, paths = trees[g]
        out += [(doc if some else None, leaf, sub, root, path + top) for (some, doc, leaf), path in zip(sorted(groups[g]), paths, strict=True)]
    return sorted(out, key=repr)


def built(spark, rows):
    docs = spark.createDataFrame([(*r, 5, "clash") for r in rows], "doc_id long, lang string, digest string, idx int, tree string")
    return m.build(docs.select("doc_id", "lang", "digest"), F.col("lang"), "doc_id")


def proved(manifest):
    found = m.proofs(manifest).collect()
    return sorted([(r.doc_id, r.digest, r.subroot, r.root, [(s.left, s.right) for s in r.path]) for r in found], key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9}, {"a": 65, "": 1, None: 3}, {"en": 512, "fr": 513, None: 7}, {"big": 4700, "x": 64}])
def test_proofs_equal_plain_trees(spark, sizes):
    rng = random.Random(1)
    rows = [(rng.randrange(-(2**60), 2**60), g, h(f"{g}{i}")) for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert proved(built(spark, rows)) == plain(rows)


def test_many_groups_and_checkpoints(spark, monkeypatch):
    for name, value in (("STEP", 1), ("BLOCK_BITS", 3), ("BLOCK", 8)):
        monkeypatch.setattr(m, name, value)
    rng = random.Random(3)
    rows = [(i, f"g{rng.randrange(90)}" if i % 3 else "hot", h(str(i))) for i in range(900)]
    assert proved(built(spark, rows)) == plain(rows)


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(1, "en", h("a")), (1, "en", h("b")), (1, "en", h("a")), (None, "en", h("c")), (None, None, h("d")), (2, "en", h("e"))]
    assert proved(built(spark, rows)) == plain(rows)


def test_a_changed_row_is_found(spark):
    docs = spark.createDataFrame([(i, f"Text {i}" if i % 2 else f"text {i}") for i in range(100)], "doc_id long, text string")
    leaves = docs.select(
        "doc_id", m.leaf(F.col("doc_id"), F.col("text")).alias("digest"), m.leaf(F.col("doc_id"), F.lower("text")).alias("shown")
    )
    found = m.build(leaves, F.lit(None).cast("string"), "doc_id").leaves(
        lambda x, path: F.struct(x["doc_id"].alias("doc_id"), m.fold(x["shown"], path).alias("folded"))
    )
    for r in found.collect():
        assert (r.folded == r.root) == (r.doc_id % 2 == 0)


def test_leaf_values(spark):
    row = spark.createDataFrame([(7, None, "é:1", 3)], "doc_id long, source string, text string, n int")
    got = row.select(m.leaf(F.col("doc_id"), F.col("source"), F.col("n"), F.col("text")).alias("d")).first().d
    assert got == h("1:7-1:34:é:1")


def test_empty_table(spark):
    manifest = built(spark, [])
    assert proved(manifest) == [] and manifest.root.count() == 0
