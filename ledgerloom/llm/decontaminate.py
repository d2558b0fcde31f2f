"""Benchmark decontamination by a prefix-filtered set join.

A window of an item occurs in a document only if all its shingles do, so it is enough to look
for the rarest one: the necessary prefix of an exact containment. One pass over the documents
keeps the positions whose shingle occurs in the benchmark; their counts order the shingles by
rarity; each window joins the positions of its rarest shingle, must fit between the ends of the
document at that offset, and is then compared word for word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import stage
from .common import ascii_lower

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
# A table of bits tells most other shingles apart before any join: bits for each benchmark
# shingle, and bounds of the table as powers of two.
BITS_EACH = 64
LEAST_BITS, MOST_BITS = 16, 22
# Windows and shingles are sent to all tasks up to so many rows; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """Digits, letters and everything beyond ASCII, A-Z in lower case; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _joined(array: Column, start: Column, length: Column | int) -> Column:
    return F.array_join(F.slice(array, start, length), " ")


def item_windows(items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """(item_id, n, body): every window of ``window`` words, or all words of a shorter item."""
    split = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("w") - n + 1)
    return split.select("item_id", "w", n.alias("n"), F.explode(starts).alias("at")).select(
        "item_id", "n", _joined(F.col("w"), F.col("at"), F.col("n")).alias("body")
    )


def _shingles(bodies: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """(body, n, k, offset, h, shingle) for each distinct window; k words, fewer in short ones."""
    k = F.least("n", F.lit(size))
    split = bodies.select("body", "n", k.alias("k"), F.split("body", " ").alias("w"))
    offsets = F.sequence(F.lit(0), F.col("n") - F.col("k"))
    h = F.coalesce(*[F.when(F.col("k") == k, _hash(F.col("hashes"), F.col("offset"), k)) for k in range(1, size + 1)])
    return (
        split.withColumn("hashes", _word_hashes(F.col("w")))
        .select("*", F.explode(offsets).alias("offset"))
        .select("body", "n", "k", "offset", h.alias("h"), _joined(F.col("w"), F.col("offset") + 1, F.col("k")).alias("shingle"))
    )


def _word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def _hash(hashes: Column, before: Column, k: int) -> Column:
    """Hash of the k words after the first ``before`` ones."""
    return F.xxhash64(*[F.get(hashes, before + i) for i in range(k)])


def _bit_places(h: Column, bits: int) -> tuple[Column, Column]:
    mask = F.lit((1 << bits) - 1)
    return h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask)


def _bit_table(hashes: DataFrame, bits: int) -> Column:
    """The bits of all ``h`` as a constant array of longs: at most 2^MOST_BITS bits."""
    rows = (
        hashes.select(F.explode(F.array(*_bit_places(F.col("h"), bits))).alias("place"))
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("set"))
        .collect()
    )
    table = dict.fromkeys(range(1 << (bits - 6)), 0) | {r["word"]: r["set"] for r in rows}
    return F.split(F.lit(",".join(map(str, table.values()))), ",").cast("array<bigint>")


def _has(table: Column, place: Column) -> Column:
    word = F.get(table, F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63)).cast("int"))
    return bit.bitwiseAND(F.lit(1)) == 1


def _known_places(k: int, window: int, table: Column, bits: int) -> Column:
    """Positions in ``w`` whose shingle of ``k`` words seems to be known, with what follows there."""

    def seen(pos: Column) -> Column:
        first, second = _bit_places(_hash(F.col("hashes"), pos - 1, k), bits)
        return _has(table, first) & _has(table, second)

    def place(pos: Column) -> Column:
        return F.struct(
            pos.cast("int").alias("pos"),
            F.lit(k).alias("k"),
            _joined(F.col("w"), pos, k).alias("shingle"),
            _joined(F.col("w"), pos, window).alias("ahead"),
        )

    places = F.when(F.size("w") >= k, F.sequence(F.lit(1), F.size("w") - k + 1))
    return F.transform(F.filter(F.coalesce(places, F.array().cast("array<int>")), seen), place)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def with_hits(docs: DataFrame, items: DataFrame, *, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Each row of ``docs`` with n_words, n_hit and item_ids, next to ``row_no`` and doc_id.

    n_hit counts the words inside any occurrence of a window; item_ids are those of the items
    with an occurring window, sorted as strings. Null texts have no words, null or wordless
    items no window, and an item without id occurs under the id null, which is not listed;
    repeated rows each get their result. Of ``docs`` only doc_id and text are read.
    """
    rows, hits, named = _search(docs.select("doc_id", "text"), items, window, shingle)
    return rows.join(_covered(hits), "row_no", "left").join(named, "row_no", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def clean(docs: DataFrame, items: DataFrame, *, window: int = WINDOW_WORDS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, as they are.

    Rows go by a digest of their text: repeated rows and rows without doc_id share the decision
    of their text, whichever other columns they have.
    """
    keyed = docs.withColumn("_digest", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    texts = keyed.select(F.col("_digest").alias("doc_id"), "text")
    rows, hits, _ = _search(texts, items, window, shingle)
    dirty = rows.join(hits.select("row_no").distinct(), "row_no", "left_semi").select(F.col("doc_id").alias("_digest")).distinct()
    return keyed.join(dirty, "_digest", "left_anti").select(*docs.columns)


def _search(docs: DataFrame, items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (row_no, doc_id, n_words), occurrences (row_no, start, n, body), items by row_no."""
    windows = stage(item_windows(items.select("item_id", "text"), window).distinct(), "windows")
    parts = stage(_shingles(windows.select("body", "n").distinct(), shingle), "shingles")
    known = parts.select("k", "h").distinct()
    sizes = {r["k"]: r["count"] for r in known.groupBy("k").count().collect()}
    n_parts = parts.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (BITS_EACH * max(1, sum(sizes.values()))).bit_length()))
    table = _bit_table(known, bits)

    split = docs.select("doc_id", words(F.col("text")).alias("w")).withColumn("hashes", _word_hashes(F.col("w")))
    found = F.concat(
        F.array().cast("array<struct<pos:int,k:int,shingle:string,ahead:string>>"),
        *[_known_places(k, window, table, bits) for k in sorted(sizes)],
    )
    rows = stage(
        split.select(
            F.monotonically_increasing_id().alias("row_no"), "doc_id", F.size("w").cast("long").alias("n_words"), found.alias("found")
        ),
        "found",
    )
    spots = rows.select("row_no", F.col("n_words").cast("int").alias("n_words"), F.explode("found").alias("f")).select(
        "row_no", "n_words", "f.*"
    )
    counts = spots.groupBy("k", "shingle").agg(F.count(F.lit(1)).alias("occurs"))
    rarest = Window.partitionBy("body").orderBy("occurs", "offset")
    prefix = (
        parts.join(_small(counts.join(_small(parts.select("k", "shingle").distinct(), n_parts), ["k", "shingle"]), n_parts), ["k", "shingle"], "left")
        .withColumn("occurs", F.coalesce("occurs", F.lit(0)))
        .withColumn("place", F.row_number().over(rarest))
        .where("place = 1 and occurs > 0")
        .select("k", "shingle", "offset", "n", "body")
    )
    prefix = stage(prefix, "prefixes")
    started = (
        spots.select("row_no", "n_words", "pos", "k", "shingle")
        .join(_small(prefix, n_parts), ["k", "shingle"])
        .withColumn("start", F.col("pos") - F.col("offset"))
        .where((F.col("start") >= 1) & (F.col("start") + F.col("n") - 1 <= F.col("n_words")))
        .select("row_no", "start", "k", "n", "body")
    )
    # what stands at the start was kept with the window's own first shingle
    ahead = spots.select("row_no", F.col("pos").alias("start"), "k", "ahead")
    same = F.expr("substring_index(ahead, ' ', n)") == F.col("body")
    verified = started.join(ahead, ["row_no", "start", "k"]).where(same).select("row_no", "start", "n", "body")
    named = (
        verified.select("row_no", "body")
        .distinct()
        .join(_small(windows.select("body", "item_id"), windows.count()), "body")
        .select("row_no", F.col("item_id").cast("string").alias("item"))
        .distinct()
        .groupBy("row_no")
        .agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    )
    return rows.select("row_no", "doc_id", "n_words"), verified, named


def _covered(hits: DataFrame) -> DataFrame:
    """(row_no, n_hit): words inside any occurrence."""
    return (
        hits.select("row_no", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("word"))
        .distinct()
        .groupBy("row_no")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
