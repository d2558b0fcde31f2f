"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the text contracts: space and the control characters 9 to 13.
SPACE = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Characters of texts that a Python worker takes up together. Spark cuts Arrow batches at 64 MB;
# what is made of them at a time is bounded here, whatever the session sets.
PIECE_CHARS = 2 << 20


def pieces(texts: Iterable[str | None], most: int = PIECE_CHARS) -> Iterator[list[str | None]]:
    """Neighbouring texts of about ``most`` characters together; a longer text comes alone."""
    some, held = [], 0
    for text in texts:
        size = len(text) if text else 0
        if some and held + size > most:
            yield some
            some, held = [], 0
        some.append(text)
        held += size
    if some:
        yield some


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone; every other character stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def doc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``modulus``."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % modulus
