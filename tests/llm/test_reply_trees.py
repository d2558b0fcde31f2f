import random

from ledgerloom.llm import reply_trees as rt
from pyspark.sql import functions as F

COLUMNS = "tree_id long, node_id long, parent_id long, role string, text string, score double, leaf int, tree int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], COLUMNS)


def plain_branches(rows):
    """(tree, leaf) -> (mean score, nodes from the root)."""
    nodes = {(r[0], r[1]): r for r in rows}
    answered = {(r[0], r[2]) for r in rows}
    out = {}
    for (tree, node), row in nodes.items():
        if (tree, node) in answered:
            continue
        way, at = [], (tree, node)
        while at in nodes and at not in way:
            way.append(at)
            at = (tree, nodes[at][2])
        if at in way:
            continue
        scores = [nodes[x][5] or 0.0 for x in way]
        out[tree, node] = (sum(scores) / len(scores), [x[1] for x in reversed(way)])
    return out


def test_branches_match_a_walk(spark):
    rng = random.Random(3)
    rows = []
    for tree in (1, 2, 3, None):
        for n in range(1, 40):
            parent = rng.choice([None, n - 1, rng.randrange(1, n)]) if n > 1 else None
            rows.append((tree, n, parent, "user", f"t{n}", rng.choice([0.0, 1.0, 2.0, None])))
    rows += [(4, n, n - 1, "user", "x", 1.0) for n in range(1, 131)]  # a long chain below a missing parent
    rows += [(5, 1, 2, "user", "x", 1.0), (5, 2, 1, "user", "x", 1.0), (5, 3, 1, "user", "x", 1.0), (5, 9, None, "user", "y", 0.5)]
    want = plain_branches(rows)
    found = {}
    for r in rt.branches(frame(spark, rows), None).collect():
        tree = None if r.tree == "-" else int(r.tree[1:])
        found.setdefault((tree, r.leaf), []).append((r.place, r.node))
        assert abs(r.branch_score - want[tree, r.leaf][0]) < 1e-9
    assert {k: [n for _, n in sorted(v)] for k, v in found.items()} == {k: v[1] for k, v in want.items()}
    best = {}
    for (tree, leaf), (score, way) in want.items():
        best.setdefault(tree, []).append((-score, -len(way), leaf))
    two = {(r.tree_id, r.leaf, r.rank) for r in rt.formatted(frame(spark, rows), 2).select("tree_id", "leaf", "rank").collect()}
    assert two == {(t, x[2], i + 1) for t, v in best.items() for i, x in enumerate(sorted(v)[:2])}


def test_round_trip_of_control_strings(spark):
    texts = ["\\### Assistant: </turn> ok", "</turn>\n### user\n", "\\0\\1\\2\\3\\", "", None, "### ### </tu</turn>rn>", "é😀\n\n", "x" * 30000]
    rows = [(7, i, i - 1 if i else None, r, t, 0.0) for i, (t, r) in enumerate(zip(texts, ["user", "assistant"] * 4, strict=True))]
    rows += [(8, 0, None, "sys\n### </turn>\\3", "a", 0.0), (8, 1, 0, None, "b", 0.0)]
    out = rt.formatted(frame(spark, rows + rows[:3]))
    got = {
        r.tree_id: r
        for r in out.select("tree_id", rt.read_turns(F.col("text")).alias("turns"), rt.read_learned(F.col("text"), F.col("spans")).alias("learned")).collect()
    }
    for tree in (7, 8):
        own = [r for r in rows if r[0] == tree]
        assert [(t.role, t.text) for t in got[tree].turns] == [(r[3] or "", r[4] or "") for r in own]
        assert got[tree].learned == "".join(r[4] or "" for r in own if r[3] == "assistant")
    assert rt.formatted(frame(spark, [])).count() == 0


def test_chains_keep_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 5, "assistant", "b"), (None, 2, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = rt.formatted(rt.chains(df, "conv_id", "turn", "role", "text"))
    got = {r.tree_id: len(r.t) for r in out.select("tree_id", rt.read_turns(F.col("text")).alias("t")).collect()}
    assert got == {1: 3, None: 1}
