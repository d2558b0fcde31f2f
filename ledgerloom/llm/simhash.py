"""SimHash near-duplicates by multi-index hashing.

Fingerprints of 64 bits are cut into two segments of 32. Two fingerprints at most ``radius``
bits apart are close in one of the segments, so each fingerprint looks up a small Hamming ball
of each segment in the table of all segments, and the full distance of every match is verified.
A segment value that very many fingerprints share is not scanned: its lookups also enumerate
the ball of the other segment and fetch whole fingerprints, which finds the same links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import stage
from .components import components

SEED = 42
SEGMENT_BITS = 32
LOW = (1 << SEGMENT_BITS) - 1
# Distinct fingerprints that may share a segment value before whole fingerprints are looked up.
BUCKET = 256


def fingerprint_of(text: str | None, shingle_words: int = 3) -> int:
    """The unsigned fingerprint of one text; zero when it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(shingle_words)], strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle_words: int = 3) -> Column:
    """The fingerprint as a signed long with the same bits; a null text has none set."""

    @pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = np.fromiter((fingerprint_of(t, shingle_words) for t in texts), np.uint64, len(texts))
            yield pd.Series(found.view(np.int64))

    return prints(text)


def ball(radius: int) -> list[int]:
    """Masks of at most ``radius`` set bits within a segment."""
    return [
        sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(SEGMENT_BITS), n)
    ]


def _masked(value: Column, radius: int) -> Column:
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius)])
    return F.explode(F.transform(masks, lambda m: value.bitwiseXOR(m)))


def links(prints: DataFrame, radius: int = 2, *, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at most ``radius`` bits apart.

    ``prints`` has one column ``fp`` of distinct longs. Radii 0 to 5 keep the balls small. Spark
    sizes the lookups like the fingerprints they are made of, though there are as many for each as
    its balls have masks: their joins sort both sides, and neither is sent to the driver.
    """
    first = radius // 2
    second = radius - first - 1
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    low = F.col("fp").bitwiseAND(F.lit(LOW))
    parts = [(0, high, low, first)] + ([(1, low, high, second)] if second >= 0 else [])
    entries, probes = [], []
    for segment, own, other, reach in parts:
        named = prints.select("fp", own.alias("own"), other.alias("other"), F.lit(segment).alias("segment"))
        entries.append(named.select("segment", F.col("own").alias("key"), F.col("fp").alias("b")))
        probes.append(
            named.select("segment", "own", "other", "fp", _masked(F.col("own"), reach).alias("key")).select(
                "segment", "key", F.col("fp").alias("a"), "other", F.bit_count(F.col("own").bitwiseXOR(F.col("key"))).alias("spent")
            )
        )
    entry, probe = entries[0], probes[0]
    for e, p in zip(entries[1:], probes[1:], strict=True):
        entry, probe = entry.unionByName(e), probe.unionByName(p)
    sizes = entry.groupBy("segment", "key").agg(F.count(F.lit(1)).alias("held"))
    sized = probe.join(sizes.hint("merge"), ["segment", "key"])
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    scanned = (
        sized.where(F.col("held") <= bucket)
        .join(entry.hint("merge"), ["segment", "key"])
        .where((F.col("a") < F.col("b")) & near)
        .select("a", "b")
    )
    crowded = sized.where(F.col("held") > bucket)
    whole = None
    for spent in range(first + 1):
        tried = crowded.where(F.col("spent") == spent).select(
            "segment", "key", "a", _masked(F.col("other"), radius - spent).alias("rest")
        )
        whole = tried if whole is None else whole.unionByName(tried)
    joined = F.when(
        F.col("segment") == 0, F.shiftleft("key", SEGMENT_BITS).bitwiseOR(F.col("rest"))
    ).otherwise(F.shiftleft("rest", SEGMENT_BITS).bitwiseOR(F.col("key")))
    fetched = (
        whole.select("a", joined.alias("b"))
        .where("a < b")
        .join(prints.select(F.col("fp").alias("b")), "b")
        .select("a", "b")
    )
    return scanned.unionByName(fetched).distinct()


def groups(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``prints`` that links to another one."""
    distinct = stage(prints.select("fp").distinct(), "fingerprints")
    return components(links(distinct, radius), "a", "b").select(F.col("node").alias("fp"), "root")


def with_components(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    A null or wordless text has fingerprint zero and is linked like any other; repeated rows
    get equal results; rows without doc_id belong to components like others but never name one
    (component_id is null when no member has an id). Other columns are not read.
    """
    marked = stage(docs.select("doc_id", fingerprint(F.col("text"), shingle_words).alias("fp")), "simhash")
    least = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = least.join(groups(marked, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    """Sixteen lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """The rows of ``docs`` of which each group of linked fingerprints keeps one.

    The row with the group's smallest doc_id stays; of several rows with that id the one whose
    text has the least hash, and one of them where id and text repeat. Texts without words are
    copies of each other. Rows without doc_id, which no group can be named after, all stay.
    """
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.where("doc_id is not null")
    marked = stage(
        named.select("doc_id", text_hash.alias("content"), fingerprint(F.col("text"), shingle_words).alias("fp")), "simhash"
    )
    rooted = marked.join(groups(marked, radius), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("least")).select("least.*")
    rows = named.select(F.struct("*").alias("row"), "doc_id", text_hash.alias("content"))
    same = Window.partitionBy("doc_id", "content").orderBy("doc_id")
    stay = rows.join(kept, ["doc_id", "content"]).withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return stay.select("row.*").unionByName(docs.where("doc_id is null"))
