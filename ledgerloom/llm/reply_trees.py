"""Chat formatting of reply trees.

Messages answer messages; every way from a first message to an unanswered one is a branch.
Self-joins that double their reach give each message its 2^k-th ancestor and the score of the
way up, so that a branch of n messages takes log2(n) joins. The best branches of a tree are
chosen by score, and only those are spelled out and formatted, each as one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

HEAD, END = "### ", "</turn>\n"
# Strings of the template and what stands for them in a text; the sign for signs goes first.
ESCAPES = [("\\", "\\0"), ("</turn>", "\\1"), ("### ", "\\2"), ("\n", "\\3")]
LINE_BREAK = 3  # only roles escape line breaks


def escaped(text: Column, *, role: bool = False) -> Column:
    """``text`` without any string of the template; ``plain`` undoes it."""
    for raw, sign in ESCAPES if role else ESCAPES[:LINE_BREAK]:
        text = F.replace(text, F.lit(raw), F.lit(sign))
    return text


def plain(text: Column, *, role: bool = False) -> Column:
    for raw, sign in reversed(ESCAPES if role else ESCAPES[:LINE_BREAK]):
        text = F.replace(text, F.lit(sign), F.lit(raw))
    return text


def _nodes(messages: DataFrame) -> DataFrame:
    """Narrow rows (tree, node, parent, score); ids as text, so that a null id is a tree too."""
    return messages.select(
        F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("-")).alias("tree"),
        F.col("node_id").alias("node"),
        F.col("parent_id").alias("parent"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )


def _ancestors(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of 2^k-th ancestors (tree, node, up), and (tree, node, total, depth) of all nodes.

    A message whose chain of parents never ends is in neither of the last two.
    """
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    reach = stage(
        nodes.join(known, ["tree", "parent"], "left").select(
            "tree",
            "node",
            F.when(F.col("there"), F.col("parent")).alias("up"),
            F.col("score").alias("total"),
            F.lit(1).cast("long").alias("depth"),
        ),
        "reach",
    )
    jumps, rows = [], reach.count()
    # rows at their root are done; only the others are joined again
    done, active = reach.where("up is null"), reach.where("up is not null")
    while not active.isEmpty() and 1 << len(jumps) <= 2 * rows:
        jumps.append(active.select("tree", "node", "up"))
        above = done.unionByName(active).select(
            "tree",
            F.col("node").alias("up"),
            F.col("up").alias("further"),
            F.col("total").alias("more"),
            F.col("depth").alias("higher"),
        )
        reach = stage(
            active.join(above, ["tree", "up"]).select(
                "tree",
                "node",
                F.col("further").alias("up"),
                (F.col("total") + F.col("more")).alias("total"),
                (F.col("depth") + F.col("higher")).alias("depth"),
            ),
            "reach",
        )
        done, active = done.unionByName(reach.where("up is null")), reach.where("up is not null")
    return jumps, done.select("tree", "node", "total", "depth")


def branches(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, branch_score, node, place): the messages of the chosen branches.

    ``messages`` has tree_id, node_id, parent_id and score. ``place`` counts from 1 at the root.
    The score of a branch is the mean of its messages' (null: 0); ties go to the longer branch,
    then to the smaller leaf. ``keep`` branches are chosen in each tree, all with None. A parent
    that is not in the tree makes a first message; a message that is its own forefather is in no
    branch. node_id is unique in a tree and not null.
    """
    nodes = stage(_nodes(messages), "messages")
    jumps, reached = _ancestors(nodes)
    answered = nodes.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = reached.join(answered, ["tree", "node"], "left_anti").select(
        "tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("branch_score"), "depth"
    )
    best = Window.partitionBy("tree").orderBy(F.desc("branch_score"), F.desc("depth"), "leaf")
    if keep is None:
        chosen = leaves.withColumn("rank", F.lit(None).cast("int"))
    else:
        chosen = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    chosen = stage(chosen, "branches")
    way = chosen.select("*", F.col("leaf").alias("node"), F.col("depth").alias("place"))
    for k, jump in reversed(list(enumerate(jumps))):
        # every message so far stays, and its 2^k-th ancestor joins it
        own = F.struct("node", "place")
        higher = F.struct(F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        both = F.when(F.col("up").isNull(), F.array(own)).otherwise(F.array(own, higher))
        way = (
            way.join(jump, ["tree", "node"], "left")
            .select("tree", "leaf", "branch_score", "rank", F.explode(both).alias("at"))
            .select("tree", "leaf", "branch_score", "rank", "at.*")
        )
    return way.select("tree", "leaf", "branch_score", "rank", "node", "place")


def formatted(messages: DataFrame, keep: int | None = 1, *, learned: str = "assistant") -> DataFrame:
    """Each chosen branch as one text: (tree_id, leaf, rank, branch_score, text, spans).

    A turn is ``### role``, a line break, its text and ``</turn>`` with a line break; strings of
    the template inside texts and roles are escaped. ``spans`` are the places of the ``learned``
    role's texts, first code point and end, the loss mask. Null texts and roles count as empty.
    Repeated rows, which would share a node_id, count once; other columns are not read.
    """
    rows = messages.select("tree_id", "node_id", "parent_id", "role", "text", "score").dropDuplicates(["tree_id", "node_id"])
    way = branches(rows, keep)
    tree = F.coalesce(F.concat(F.lit("="), F.col("tree_id").cast("string")), F.lit("-")).alias("tree")
    said = rows.select(
        tree,
        F.col("node_id").alias("node"),
        "tree_id",
        F.coalesce("role", F.lit("")).alias("role"),
        escaped(F.coalesce("text", F.lit(""))).alias("body"),
    )
    turn = F.concat(F.lit(HEAD), escaped(F.col("role"), role=True), F.lit("\n"), F.col("body"), F.lit(END))
    along = Window.partitionBy("tree", "leaf").orderBy("place")
    end = F.sum(F.char_length("turn")).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = (
        way.join(said, ["tree", "node"])
        .withColumn("turn", turn)
        .withColumn("stop", (end - len(END)).cast("long"))
        .withColumn("start", F.col("stop") - F.char_length("body"))
    )
    span = F.when(F.col("role") == learned, F.struct("start", "stop"))
    return (
        turns.groupBy("tree", "leaf")
        .agg(
            F.first("tree_id").alias("tree_id"),
            F.first("rank").alias("rank"),
            F.first("branch_score").alias("branch_score"),
            F.array_sort(F.collect_list(F.struct("place", "turn"))).alias("turns"),
            F.array_sort(F.collect_list(span)).alias("spans"),
        )
        .select(
            "tree_id",
            "leaf",
            "rank",
            "branch_score",
            F.array_join("turns.turn", "").alias("text"),
            "spans",
        )
    )


def read_turns(text: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.split(text, END)
    whole = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    return F.transform(
        whole,
        lambda p: F.struct(
            plain(F.substring(F.substring_index(p, "\n", 1), len(HEAD) + 1, 2**31 - 1), role=True).alias("role"),
            plain(F.call_function("substring", p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def read_learned(text: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: plain(
                F.substring(text, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
            ),
        ),
        "",
    )


def chains(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """Rows of plain conversations as trees of one branch: node_id by ``order``, parent before it.

    Rows that are equal in ``order`` follow each other in any order; none is lost.
    """
    along = Window.partitionBy(tree).orderBy(*order)
    node = F.row_number().over(along).cast("long")
    return rows.withColumn("node_id", node).select(
        F.col(tree).alias("tree_id"),
        "node_id",
        F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
    )
