"""Merkle manifest of a table, with proofs from a few stored levels.

Rows are the leaves of one tree for each group; every ``FANOUT`` neighbouring nodes become the
digest of their joined hex digests, until one node is left, and the roots of the groups become
the leaves of a last tree in the same way. Only every ``STEP``-th level is stored, packed into
one row for each aligned subtree of ``BLOCK`` nodes. A proof walks down from the root: the nodes
between two stored levels are computed anew from the subtree's stored members, its siblings are
emitted, and the nodes are dropped again. No task ever holds more than one subtree, however many
leaves a group has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
# Levels from one stored level to the next, and members of a subtree between them.
STEP = 3
BLOCK_BITS = FANOUT_BITS * STEP
BLOCK = 1 << BLOCK_BITS
# Bits below the partition number in monotonically_increasing_id.
SPOT_BITS = 33
PATH = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    """SHA-256 in lower-case hex of a text's UTF-8 bytes."""
    return F.sha2(value, 256)


def field(value: Column) -> Column:
    """One value of a leaf: ``-`` for null, else its byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of one row."""
    return digest(F.concat(*[field(v) for v in values]))


def tree_name(group: Column) -> Column:
    """A text never null that orders as the group does bytewise, null first."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where nested functions read it."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in ``tree`` by ``order`` from 0, and ``size``, its rows.

    Rows are laid out by ranges of (tree, order) and numbered where they lie; only one row for
    each tree and range is summed up, so that a tree may hold any share of the table.
    """
    columns = ["tree", *order]
    laid = stage(
        rows.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("spot", F.monotonically_increasing_id()),
        "laid",
    )
    part = F.shiftright("spot", SPOT_BITS)
    ranges = laid.groupBy("tree", part.alias("part")).agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy("tree")
    earlier = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(
        "tree",
        "part",
        (F.coalesce(F.sum("held").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(whole).alias("size"),
    )
    found = laid.withColumn("part", part).join(offsets, ["tree", "part"])
    return found.withColumn("idx", F.col("spot") + F.col("shift")).drop("part", "spot", "shift")


def height_of(size: Column) -> Column:
    """Levels above the leaves of a tree of ``size`` leaves: the least h with FANOUT^h >= size."""
    return F.when(size <= 1, 0).otherwise(F.ceil(F.length(F.bin(size - 1)) / FANOUT_BITS).cast("int"))


def _up(nodes: Column) -> Column:
    """The next level: digests of FANOUT neighbouring nodes, the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _regenerated(leaves: Column, steps: Column) -> Column:
    """The levels 0 to ``steps`` of a subtree, from the digests of its members."""
    higher = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.array(leaves),
        lambda levels, _: F.concat(levels, F.array(_up(F.element_at(levels, -1)))),
    )
    return F.when(steps == 0, F.array(leaves)).otherwise(higher)


def _digests(members: Column) -> Column:
    return F.transform(members, lambda m: m["digest"])


@dataclass
class Forest:
    """Stored levels 0, STEP, 2 STEP, ... as (tree, height, block, steps, members), and the roots (tree, root)."""

    checkpoints: list[DataFrame]
    roots: DataFrame


def forest(rows: DataFrame) -> Forest:
    """Trees over numbered rows (tree, idx, size, digest, ...); other columns stay with the leaves."""
    current = rows.withColumn("height", height_of(F.col("size"))).drop("size")
    checkpoints, roots, level = [], None, 0
    while True:
        payload = [c for c in current.columns if c not in ("tree", "height", "idx")]
        block = F.shiftright("idx", BLOCK_BITS).alias("block")
        packed = current.groupBy("tree", "height", block).agg(
            F.sort_array(F.collect_list(F.struct("idx", *payload))).alias("members")
        )
        steps = F.least(F.col("height") - level, F.lit(STEP)).alias("steps")
        stored = stage(packed.select("tree", "height", "block", steps, "members"), "merkle")
        checkpoints.append(stored)
        top = F.get(F.element_at(_regenerated(_digests(F.col("members")), F.col("steps")), -1), F.lit(0))
        tops = stored.select("tree", "height", F.col("block").alias("idx"), top.alias("digest"))
        level += STEP
        ended = tops.where(F.col("height") <= level).select("tree", F.col("digest").alias("root"))
        roots = ended if roots is None else roots.unionByName(ended)
        current = tops.where(F.col("height") > level)
        if stored.where(F.col("height") > level).isEmpty():
            return Forest(checkpoints, stage(roots, "roots"))


def _sides(nodes: Column, at: Column) -> Column:
    """The siblings left and right of node ``at`` in its run, each side joined."""
    begin = at - F.pmod(at, F.lit(FANOUT))
    left = F.array_join(F.slice(nodes, begin + 1, at - begin), "")
    right = F.array_join(F.slice(nodes, at + 2, begin + (FANOUT - 1) - at), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _path(levels: Column, steps: Column, idx: Column) -> Column:
    """Siblings of a member of a subtree, level by level up to the subtree's root."""
    place = F.pmod(idx, F.lit(BLOCK)).cast("int")
    found = F.transform(
        F.sequence(F.lit(0), steps - 1),
        lambda level: _sides(F.get(levels, level), F.floor(place / F.pow(F.lit(FANOUT), level)).cast("int")),
    )
    return F.when(steps == 0, F.array().cast(PATH)).otherwise(found)


def _walk(trees: Forest, above: DataFrame, use: Callable[[Column, Column], Column]) -> DataFrame:
    """``use(member, path to the root)``, a struct, for every leaf, beside the columns of ``above``.

    ``above`` is (tree, path, ...): what continues the paths of a tree past its own root.
    """
    carried = [c for c in above.columns if c not in ("tree", "path")]
    below = None
    for number in range(len(trees.checkpoints) - 1, -1, -1):
        stored, ends = trees.checkpoints[number], F.col("height") <= (number + 1) * STEP
        joined = stored.where(ends).join(above, "tree")
        if below is not None:
            joined = joined.unionByName(stored.where(~ends).join(below, ["tree", "block"]))

        def emitted(levels: Column, number: int = number) -> Column:
            def one(m: Column) -> Column:
                whole = F.concat(_path(levels, F.col("steps"), m["idx"]), F.col("path"))
                if number:
                    return F.struct(m["idx"].alias("block"), whole.alias("path"))
                return _bound(whole, lambda path: use(m, path))

            return F.transform("members", one)

        rows = _bound(_regenerated(_digests(F.col("members")), F.col("steps")), emitted)
        found = joined.select("tree", *carried, F.explode(rows).alias("found"))
        below = found.select("tree", *carried, "found.*")
        if number:
            below = stage(below, "paths")
    return below


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest gives with the siblings of ``path``."""
    return F.aggregate(path, start, lambda node, s: digest(F.concat(s["left"], node, s["right"])))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path in order."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


@dataclass
class Manifest:
    """The trees of all groups and the tree over their roots."""

    groups: Forest
    top: Forest

    @property
    def root(self) -> DataFrame:
        """One row (root), none for an empty table."""
        return self.top.roots.select("root")

    def leaves(self, use: Callable[[Column, Column], Column]) -> DataFrame:
        """``use(member, path)`` for every leaf, with tree, subroot and root."""
        start = self.top.roots.select("tree", "root", F.array().cast(PATH).alias("path"))
        tops = _walk(
            self.top,
            start,
            lambda m, path: F.struct(m["name"].alias("name"), m["digest"].alias("subroot"), path.alias("path")),
        )
        return _walk(self.groups, tops.select(F.col("name").alias("tree"), "subroot", "root", "path"), use)


def build(rows: DataFrame, group: Column, order: str) -> Manifest:
    """A manifest over ``rows`` with a column ``digest``; leaves ascend by ``order`` in their group.

    Null groups and null orders come first; equal orders follow by digest, and repeated rows are
    leaves of their own. The other columns stay with the leaves as members' fields.
    """
    named = stage(rows.withColumn("tree", tree_name(group)), "leaves")
    groups = forest(numbered(named, [order, "digest"]))
    names = groups.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    return Manifest(groups, forest(numbered(names, ["name"])))


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, subroot, root, the leaf's fields, path): a whole inclusion proof of every leaf."""
    found = manifest.leaves(lambda m, path: F.struct(m.alias("leaf"), path.alias("path")))
    return found.select("tree", "subroot", "root", "leaf.*", "path")
