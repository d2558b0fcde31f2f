"""Shards of equal row counts by balanced label propagation.

Documents are linked through hubs (here: equal texts), so that a group of n documents has n
links and not n^2. In every round each hub counts its documents in each shard and names the
shards that hold most of them, as many as its documents need; documents elsewhere move there,
as far as the shard's quota allows. A last pass evens the counts out exactly, moving documents
without links first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage, unstage

LAW = "rows"
ROUNDS = 6
# Rows of one shard that are numbered in one task.
BUCKET_ROWS = 50_000


def _chance(*parts: str | Column) -> Column:
    """A fixed pseudo-random number from 0 up to 1 for each value of ``parts``."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 30)) / float(1 << 30)


def _per_shard(rows: DataFrame, shards: int, *values: Column) -> list[list[int]]:
    """Sums for each shard: ``shards`` small lists, whatever the number of rows."""
    names = [f"v{i}" for i in range(len(values))]
    found = rows.groupBy("shard").agg(*[F.sum(v).alias(n) for v, n in zip(values, names, strict=True)])
    out = [[0] * len(values) for _ in range(shards)]
    for r in found.collect():
        out[r["shard"]] = [r[n] or 0 for n in names]
    return out


def _choose(values: list, place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place)


def quotas(rows: int, shards: int) -> list[int]:
    """Sizes at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _moved(placed: DataFrame, wanted: list[int], turn: int) -> tuple[DataFrame, int]:
    """One round over (row_no, hub, mix, shard): the new places, staged, and the number of moves."""
    shards, share = len(wanted), max(1, min(wanted))
    held = placed.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "shard")))
    homes = held.groupBy("hub").agg(F.sum("n").alias("members"), ranked.alias("ranked"))
    need = F.ceil(F.col("members") / share).cast("int")
    homes = homes.select("hub", "ranked", F.least(need, F.lit(shards)).alias("need"))
    # a hub that needs more shards than it is in takes the ones after its first as well
    spread = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: (F.col("ranked")[0]["shard"] + i) % shards)
    homes = homes.select(
        "hub", "need", F.slice(F.array_distinct(F.concat(F.col("ranked.shard"), spread)), F.lit(1), F.col("need")).alias("homes")
    )
    goal = F.get("homes", F.pmod(F.xxhash64("mix", F.lit(turn)), F.col("need")).cast("int"))
    linked_rows = placed.where("hub is not null").join(homes, "hub").select(
        "row_no",
        "hub",
        "mix",
        "shard",
        F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(goal).alias("goal"),
        # small groups move whole
        F.when(F.col("need") > 1, _chance("mix", F.lit(turn))).otherwise(_chance("hub", F.lit(turn))).alias("chance"),
    )
    # rows without a hub stay, and are not shuffled to meet on it
    single_rows = placed.where("hub is null").select("*", F.col("shard").alias("goal"), F.lit(1.0).alias("chance"))
    aimed = stage(linked_rows.unionByName(single_rows), "aims")
    linked = F.col("hub").isNotNull()
    stay = _per_shard(aimed.where(linked & (F.col("goal") == F.col("shard"))), shards, F.lit(1))
    come = _per_shard(aimed.where("goal <> shard").select(F.col("goal").alias("shard")), shards, F.lit(1))
    admitted = [max(0.0, min(1.0, (q - s[0]) / c[0])) if c[0] else 0.0 for q, s, c in zip(wanted, stay, come, strict=True)]
    goes = F.col("chance") < _choose(admitted, F.col("goal"))
    after = stage(
        aimed.select("row_no", "hub", "mix", F.when(goes, F.col("goal")).otherwise(F.col("shard")).alias("shard")), "places"
    )
    unstage(aimed)
    return after, sum(c[0] for c in come)


def _levelled(placed: DataFrame, wanted: list[int], rows: int) -> DataFrame:
    """(row_no, shard, slot): every shard gets exactly its quota, slots without gaps."""
    shards = len(wanted)
    buckets = max(1, rows // (shards * BUCKET_ROWS) + 1)
    named = placed.select(
        "row_no", "shard", "mix", F.col("hub").isNull().alias("free"), F.pmod("mix", F.lit(buckets)).alias("bucket")
    )
    sizes = named.groupBy("shard", "free", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("free", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "free", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "free", "bucket").orderBy("mix", "row_no")
    numbered = (
        named.withColumn("nth", F.row_number().over(inside).cast("long"))
        .join(starts, ["shard", "free", "bucket"])
        .select("row_no", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))
    )
    counts = [c[0] for c in _per_shard(placed, shards, F.lit(1))]
    over = [max(0, c - q) for c, q in zip(counts, wanted, strict=True)]
    room = [max(0, q - c) for c, q in zip(counts, wanted, strict=True)]
    over_before = [sum(over[:s]) for s in range(shards)]
    room_until = [sum(room[: s + 1]) for s in range(shards)]
    quota = _choose(wanted, F.col("shard"))
    surplus = F.when(F.col("slot") >= quota, _choose(over_before, F.col("shard")) + F.col("slot") - quota)
    target = F.size(F.filter(F.array(*[F.lit(r) for r in room_until]), lambda r: r <= F.col("surplus")))
    taken = _choose([c - (u - r) for c, u, r in zip(counts, room_until, room, strict=True)], F.col("target"))
    return (
        numbered.withColumn("surplus", surplus.cast("long"))
        .withColumn("target", F.when(F.col("surplus").isNotNull(), target))
        .select(
            "row_no",
            F.coalesce("target", "shard").cast("int").alias("shard"),
            F.when(F.col("surplus").isNotNull(), taken + F.col("surplus")).otherwise(F.col("slot")).cast("long").alias("slot"),
        )
    )


def assign(linked: DataFrame, shards: int = 16, *, rounds: int = ROUNDS) -> DataFrame:
    """(row_no, shard, slot) for rows (row_no, hub, mix).

    ``row_no`` is unique; rows with equal ``hub`` are linked, a null hub links to none; ``mix``
    is a long that spreads rows over shards at first. Row counts of shards differ by one at
    most and slots have no gaps. A hub with more rows than a shard holds takes several shards.
    """
    rows = linked.count()
    wanted = quotas(rows, shards)
    sizes = linked.where("hub is not null").groupBy("hub").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = stage(
        linked.join(sizes, "hub", "left").select(
            "row_no",
            F.when(F.col("n") > 1, F.col("hub")).alias("hub"),
            "mix",
            F.pmod(F.xxhash64("mix"), F.lit(shards)).cast("int").alias("shard"),
        ),
        "places",
    )
    for turn in range(rounds):
        after, moves = _moved(placed, wanted, turn)
        unstage(placed)
        placed = after
        if not moves:
            break
    return _levelled(placed, wanted, rows)


def cut_links(placed: DataFrame) -> int:
    """Links of (hub, shard) rows that are cut: rows of a hub outside its largest shard."""
    held = placed.where("hub is not null").groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    lost = held.groupBy("hub").agg((F.sum("n") - F.max("n")).alias("cut"))
    return lost.agg(F.coalesce(F.sum("cut"), F.lit(0))).first()[0]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, hub, shard and slot of every row; equal texts are linked.

    A null text counts as empty: size 1, crc32 0. Repeated rows and null ids are rows like any
    other; an empty table gives an empty one. Only doc_id and text are read.
    """
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    rows = stage(
        docs.select("doc_id", data.alias("data")).select(
            F.monotonically_increasing_id().alias("row_no"),
            "doc_id",
            (F.octet_length("data") + 1).cast("long").alias("size"),
            F.crc32("data").alias("text_crc32"),
            F.sha2("data", 256).alias("hub"),
        ),
        "sizes",
    )
    mix = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "hub", "row_no").alias("mix")
    return rows.join(assign(rows.select("row_no", "hub", mix), shards), "row_no").select(
        "doc_id", "size", "text_crc32", "hub", "shard", "slot"
    )
