"""Document fingerprints by winnowing.

The words of a text give one hash for every ``KGRAM`` neighbouring words; of every ``WINDOW``
neighbouring hashes the smallest one is chosen, the rightmost on ties. What is chosen, with its
position, is the fingerprint: two texts that share ``KGRAM + WINDOW - 1`` words in a row share
at least one chosen hash. Texts of few words, or of very long ones as where no spaces are written,
are winnowed by characters as well: two of them share a hash if they share
``CHAR_KGRAM + CHAR_WINDOW - 1`` characters in a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .common import SPACE

KGRAM = 5
WINDOW = 8
# The same for characters, in texts of fewer words, or of more characters a word, than these.
CHAR_KGRAM = 8
CHAR_WINDOW = 9
FEW_WORDS = 2 * (KGRAM + WINDOW)
LONG_WORDS = 32
# Prime modulus and base of the k-gram hash: products stay below 2^62.
PRIME = (1 << 31) - 1
BASE = 1_000_003
POSITION_BITS = 31
LAST = (1 << POSITION_BITS) - 1
# Neighbouring ids that share a block, as a power of two.
BLOCK_BITS = 10
# Blocks whose heads are sent to all tasks; more are joined by a shuffle of the texts.
BROADCAST_BLOCKS = 200_000


def chosen(text: Column, k: int = KGRAM, window: int = WINDOW) -> Column:
    """The fingerprint as an array of longs, hash and position packed, in order of position.

    Each long holds the hash in its high bits and the position, counted back, in its low 31, so
    that the least long of a window is the least hash, the rightmost on ties. A text of fewer
    than ``k`` words has one hash, of all its words; one of no words (null, empty) has none. A
    text of fewer hashes than ``window`` is one window. What characters give stands behind, for
    texts with FEW_WORDS or LONG_WORDS that have CHAR_KGRAM characters besides white space around.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, f"[{SPACE}]+"), lambda w: w != "")

    def both(w: Column) -> Column:
        by_words = _winnowed(F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(PRIME))), k, window)
        spoken = F.array_join(w, " ")
        chars = F.transform(F.split(spoken, ""), lambda x: F.pmod(F.xxhash64(F.lit("char"), x), F.lit(PRIME)))
        n_chars = F.char_length(spoken)
        few = (F.size(w) < FEW_WORDS) | (n_chars > LONG_WORDS * F.size(w))
        by_chars = F.when(few & (n_chars >= CHAR_KGRAM), _winnowed(chars, CHAR_KGRAM, CHAR_WINDOW))
        return F.concat(by_words, F.coalesce(by_chars, F.array().cast("array<bigint>")))

    return _bound(words, both)


def _winnowed(hashes: Column, k: int, window: int) -> Column:
    return _bound(_bound(hashes, lambda h: _packed(h, k)), lambda p: _windows(p, window))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where nested functions read it."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))


def _packed(hashes: Column, k: int) -> Column:
    """The polynomial hash of each k-gram, mixed, above its position counted back from 2^31 - 1.

    The hash of a gram is the one before, rolled on by a word; written here as the sum that
    rolling leaves, since the words of a gram are all at hand. Mixing makes the order fair.
    """

    def gram(i: Column) -> Column:
        rolled = F.get(hashes, i)
        for step in range(1, k):
            rolled = (rolled * BASE + F.get(hashes, i + step)) % PRIME
        return F.shiftleft(F.pmod(F.xxhash64(rolled), F.lit(1 << 32)), POSITION_BITS) + (F.lit(LAST) - i)

    n = F.size(hashes)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: gram(i))
    whole = F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: (a * BASE + h) % PRIME)
    single = F.array(F.shiftleft(F.pmod(F.xxhash64(whole), F.lit(1 << 32)), POSITION_BITS) + F.lit(LAST))
    return F.when(n >= k, grams).when(n > 0, single).otherwise(F.array().cast("array<bigint>"))


def _windows(packed: Column, window: int) -> Column:
    least = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(packed) - window + 1, F.lit(1))),
        lambda i: F.array_min(F.slice(packed, i, window)),
    )
    return F.when(F.size(packed) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))


def hashes_of(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint, without positions."""
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftrightunsigned(x, POSITION_BITS)))


def written(fingerprint: Column) -> Column:
    """As text: hash in hex, ``@``, position of the k-gram, one after the other."""
    return F.array_join(
        F.transform(
            fingerprint,
            lambda x: F.concat(
                F.lower(F.hex(F.shiftrightunsigned(x, POSITION_BITS))),
                F.lit("@"),
                (F.lit(LAST) - x.bitwiseAND(F.lit(LAST))).cast("string"),
            ),
        ),
        " ",
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints' hash arrays; 1 for two empty ones."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, F.lit(1.0)).otherwise(shared.cast("double") / every)


def following(values: DataFrame, levels: int) -> DataFrame:
    """(v, next) for distinct longs ``v`` of 0 or more: the greatest smaller one, null for the least.

    Values are cut into blocks of 2^BLOCK_BITS neighbours and ordered inside; the next block
    that holds any is found among the block numbers in the same way, one level up, so that no
    task sorts more than a block. ``levels``: how often that is needed for the range at hand.
    """
    block = F.shiftright("v", BLOCK_BITS)
    inside = Window.partitionBy("block").orderBy(F.desc("v"))
    led = values.withColumn("block", block).withColumn("next", F.lead("v").over(inside))
    if not levels:
        return led.select("v", "next")
    tops = values.groupBy(block.alias("block")).agg(F.max("v").alias("top"))
    order = following(tops.select(F.col("block").alias("v")), levels - 1)
    ahead = order.select(F.col("v").alias("block"), F.col("next").alias("next_block")).join(
        tops.select(F.col("block").alias("next_block"), F.col("top").alias("next_top")), "next_block", "left"
    )
    return led.join(ahead.select("block", "next_top"), "block").select(
        "v", F.coalesce("next", "next_top").alias("next")
    )


def _levels(most: int) -> int:
    """Levels above values from 0 to ``most`` until one block holds all."""
    levels = 0
    while most >> BLOCK_BITS:
        most, levels = most >> BLOCK_BITS, levels + 1
    return levels


def with_next(docs: DataFrame, made: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc_id, text, next_text): the text of the next document by descending doc_id.

    After the last document comes the first. Rows without doc_id come last; of rows with equal
    doc_id those with the greater text go first. Texts are shuffled once, by blocks of
    neighbouring ids; the first row of each block is also sent to the block before it. With
    ``made`` there are also made and next_made, what it makes of each text, made once a row
    where the row is read and sent along.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    least, most = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
    # blocks are numbered from 1 at the least id, over the whole range of longs; rows without id are in block 0
    base = (least or 0) >> BLOCK_BITS
    last = 0 if most is None else (most >> BLOCK_BITS) - base + 1
    block = F.coalesce(F.shiftright("doc_id", BLOCK_BITS) - F.lit(base - 1), F.lit(0).cast("long"))
    blocks = rows.groupBy(block.alias("block")).agg(F.max("doc_id").alias("top"))
    order = following(blocks.select(F.col("block").alias("v")), _levels(last))
    tops = blocks.select(F.col("block").alias("next"), "top")
    heads = (
        order.select(F.col("v").alias("sent_to"), F.coalesce("next", F.lit(last)).alias("next"))
        .join(tops, "next")
        .select("sent_to", F.col("next").alias("home"), "top")
    )
    heads = stage(heads, "heads")
    heads = F.broadcast(heads) if heads.count() <= BROADCAST_BLOCKS else heads
    homed = rows.withColumn("home", block)
    copies = homed.join(heads, "home").where(F.col("doc_id").eqNullSafe(F.col("top")))
    extra = [made(F.col("text")).alias("made")] if made else []
    sent = homed.select(F.col("home").alias("block"), F.lit(0).alias("copy"), "doc_id", "text", *extra).unionByName(
        copies.select(F.col("sent_to").alias("block"), F.lit(1).alias("copy"), "doc_id", "text", *extra)
    )
    along = Window.partitionBy("block").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("text"))
    kept = ["text"] + ["made"] * bool(made)
    ahead = [F.lead(c).over(along).alias(f"next_{c}") for c in kept]
    return sent.select("copy", "doc_id", *kept, *ahead).where("copy = 0").drop("copy")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half, rounded down, replaced by as many first characters of ``other``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.left(text, F.char_length(text) - half), F.left(other, half))


def with_edits(docs: DataFrame, k: int = KGRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text and of the next one, and their likeness.

    Columns doc_id, text, edited_text, fingerprint, edited_fingerprint (arrays of packed longs),
    near_edited and near_next. A null text counts as empty, repeated rows are rows of their own,
    other columns are not read.
    """
    pairs = with_next(docs, lambda text: chosen(text, k, window))
    marked = pairs.select(
        "doc_id",
        "text",
        edited(F.col("text"), F.col("next_text")).alias("edited_text"),
        F.col("made").alias("fingerprint"),
        hashes_of(F.col("made")).alias("own"),
        hashes_of(F.col("next_made")).alias("next_hashes"),
    ).withColumn("edited_fingerprint", chosen(F.col("edited_text"), k, window))
    return marked.select(
        "doc_id",
        "text",
        "edited_text",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own"), hashes_of(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("own"), F.col("next_hashes")).alias("near_next"),
    )
