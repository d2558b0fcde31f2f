"""Secrets in texts, told apart by who holds them.

Patterns find candidates; the hash of each candidate's value is counted over the whole corpus by
distinct repositories and owners. A value that many owners hold is an example that was copied;
one that a single owner holds and that looks random is likely a live credential. Spans of the
base patterns always count; those of the wider patterns only where their value is held so.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage


@dataclass(frozen=True)
class Kind:
    """A pattern: ``group`` holds the value, which must have ``least`` characters."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1


# The base patterns, in their order.
BASE = (
    Kind(
        "assign",
        r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
        r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    # runs of one class: the least length inside the pattern finds the same matches
    Kind("access", r"AKIA[A-Z0-9]{12,}"),
    Kind("hex", r"[0-9a-f]{32,}"),
)
# Wider patterns, whose spans count if one owner alone holds the value and it looks live.
WIDER = (
    Kind("bearer", r"[bB][eE][aA][rR][eE][rR]\x20+([A-Za-z0-9._~+/-]+=*)", 1, 16),
    Kind("login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:([^\x00-\x20/:@]+)@", 1, 6),
    Kind("issued", r"(?:gh[opsu]_|glpat-|npm_|xox[abp]-|[rs]k_live_)[A-Za-z0-9_-]+", 0, 20),
    Kind("opaque", r"[A-Za-z0-9+/_-]{20,}"),
)
# A value that more owners hold is an example; and bits per character that a live value has at least.
OWNERS = 1
LIVE_BITS = 3.0
# Values that make up more than this share of all candidates are joined by broadcast: at most as many.
HOT = 1024
BATCH_BYTES = 4 << 20
FOUND = "array<struct<start:int,kind:int,stop:int,value:binary,live:boolean>>"
_ARROW = pa.list_(
    pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("value", pa.binary()), ("live", pa.bool_())])
)


def looks_live(value: str) -> bool:
    """Random enough: letters and digits, and at least LIVE_BITS of entropy a character."""
    if not re.search("[0-9]", value) or not re.search("[A-Za-z]", value):
        return False
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) >= LIVE_BITS


# Bytes of which every match has LONG_RUN in a row, but for those of ``assign`` and ``login``.
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-.~=")] = True
LONG_RUN = 16
_SEPARATOR = re.compile("[:=]")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _names_value(text: str) -> bool:
    """Whether some name stands before a separator, as every match of ``assign`` needs."""
    for m in _SEPARATOR.finditer(text):
        at = m.start()
        while at and text[at - 1] == " ":
            at -= 1
        if at and text[at - 1] in "\"'":
            at -= 1
        if text[max(0, at - 8) : at].lower().endswith(_NAMES):
            return True
    return False


def _may_be_issued(text: str) -> bool:
    return "_" in text or "glpat-" in text or "xox" in text


# What a text must have besides a long run; the patterns decide.
_GATES = {"assign": _names_value, "login": lambda text: "://" in text, "issued": _may_be_issued}
_WITHOUT_RUN = ("assign", "login")


def suspects(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text whether it (or its neighbour) has a long run, and a separator; on the bytes of all texts."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    breaks = np.concatenate([[-1], np.flatnonzero(~_RUN_BYTES[raw]), [len(raw)]])
    gaps = np.flatnonzero(np.diff(breaks) > LONG_RUN)
    run = np.zeros(len(texts) + 1, np.int64)
    np.add.at(run, np.searchsorted(bounds, breaks[gaps] + 1, side="right") - 1, 1)
    np.add.at(run, np.searchsorted(bounds, breaks[gaps + 1] - 1, side="right"), -1)
    parts = np.flatnonzero((raw == 58) | (raw == 61))
    parted = np.zeros(len(texts), bool)
    parted[np.searchsorted(bounds, parts, side="right") - 1] = True
    return np.cumsum(run)[:-1] > 0, parted


class Scanner:
    """The compiled patterns of all kinds, for one task."""

    def __init__(self, kinds: tuple[Kind, ...]) -> None:
        self.kinds = [(i, k, re.compile(k.pattern), _GATES.get(k.name)) for i, k in enumerate(kinds)]

    def find(self, text: str, long_run: bool = True) -> list[dict]:
        """All matches of each kind, leftmost and not overlapping, by start and then by kind."""
        found = []
        for number, kind, pattern, gate in self.kinds:
            if (gate and not gate(text)) or not (long_run or kind.name in _WITHOUT_RUN):
                continue
            for m in pattern.finditer(text):
                a, b = m.span(kind.group)
                if b - a >= kind.least:
                    value = m.group(kind.group)
                    found.append(
                        {
                            "start": m.start(),
                            "kind": number,
                            "stop": m.end(),
                            "value": xxhash.xxh3_128_digest(value.encode("utf-8", "surrogatepass")),
                            "live": looks_live(value),
                        }
                    )
        found.sort(key=lambda x: (x["start"], x["kind"]))
        return found

    def find_all(self, texts: pa.Array) -> Iterator[list[dict]]:
        """``find`` for every text; only those that may hold something are read."""
        if not len(texts):
            return
        long_run, parted = suspects(texts)
        for at, (run, part) in enumerate(zip(long_run.tolist(), parted.tolist(), strict=True)):
            text = texts[at].as_py() if run or part else None
            yield self.find(text, run) if text else []


def candidates(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + WIDER) -> DataFrame:
    """``docs`` with ``text`` replaced by ``found``, the candidates of all kinds (see FOUND).

    A null text counts as empty. Texts are read whole; results leave in batches of bounded size.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in others], f"found {FOUND}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(kinds)
        for rows in batches:
            found, held, begin = [], 0, 0
            for at, one in enumerate(scanner.find_all(rows["text"])):
                found.append(one)
                held += 64 * len(one)
                if held > BATCH_BYTES:
                    yield _with_found(rows, begin, found)
                    found, held, begin = [], 0, at + 1
            if found:
                yield _with_found(rows, begin, found)

    def _with_found(rows: pa.RecordBatch, begin: int, found: list) -> pa.RecordBatch:
        part = rows.slice(begin, len(found))
        names = [f.name for f in others]
        return pa.RecordBatch.from_arrays([*[part[n] for n in names], pa.array(found, _ARROW)], [*names, "found"])

    return docs.select(*[f.name for f in others], "text").mapInArrow(run, schema)


def ownership(held: DataFrame) -> DataFrame:
    """(value, n_owners, n_repositories, n) of rows (value, owner, repository).

    Counted in three partial aggregates, so that a value in a third of all rows is counted where
    the rows lie. A null owner or repository counts as one of its own.
    """
    by_repository = held.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("value", "owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repositories"))
    return by_owner.groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n")
    )


def judged(rows: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """``rows`` (value, ...) with n_owners and n_repositories.

    Values with more than 1/HOT of all ``total`` candidates, fewer than HOT, reach every task;
    the others meet their rows by value.
    """
    counts = frequency.select("value", "n_owners", "n_repositories", "n")
    hot = F.broadcast(counts.where(F.col("n") * HOT > total))
    first = rows.join(hot.drop("n").withColumnsRenamed({"n_owners": "hot_owners", "n_repositories": "hot_repositories"}), "value", "left")
    settled = first.where("hot_owners is not null").withColumnsRenamed({"hot_owners": "n_owners", "hot_repositories": "n_repositories"})
    open_ = first.where("hot_owners is null").drop("hot_owners", "hot_repositories")
    return settled.unionByName(open_.join(counts.where(F.col("n") * HOT <= total).drop("n"), "value"))


def scan(docs: DataFrame, owner: Column, repository: Column, *, owners: int = OWNERS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, base and spans, arrays of spans by start and kind.

    A span is a struct of start, kind (its number in BASE + WIDER), stop, n_owners,
    n_repositories and verdict: ``live`` (held by ``owners`` or fewer, looks random),
    ``example`` (held by more) or ``weak``. ``base`` holds the spans of the base patterns,
    ``spans`` those and the live ones of the wider patterns that no base span of the same place
    covers. A null text has none, repeated rows count as one repository, an empty table gives no
    rows; other columns are not read.
    """
    named = docs.select("doc_id", "text", owner.cast("string").alias("owner"), repository.cast("string").alias("repository"))
    marked = stage(candidates(named).withColumn("row", F.monotonically_increasing_id()), "candidates")
    each = marked.select("row", "owner", "repository", F.explode("found").alias("c"))
    frequency = stage(ownership(each.select("c.value", "owner", "repository")), "ownership")
    total = frequency.agg(F.sum("n")).first()[0] or 0
    told = judged(each.select("row", "c.*"), frequency, total)
    verdict = (
        F.when(F.col("n_owners") > owners, F.lit("example")).when(F.col("live"), F.lit("live")).otherwise(F.lit("weak"))
    )
    span = F.struct("start", "kind", "stop", "n_owners", "n_repositories", verdict.alias("verdict"))
    of_row = told.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("all"))
    whole = marked.select("doc_id", "row").join(of_row, "row", "left")
    none = F.array().cast(of_row.schema["all"].dataType)
    every = F.coalesce("all", none)
    base = F.filter(every, lambda s: s["kind"] < len(BASE))
    return whole.select("doc_id", base.alias("base"), every.alias("all")).select(
        "doc_id",
        "base",
        F.filter(
            "all",
            lambda s: (s["kind"] < len(BASE))
            | ((s["verdict"] == "live") & ~F.exists("base", lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))),
        ).alias("spans"),
    )


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in BASE + WIDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    number = [k.name for k in BASE + WIDER].index(kind)
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")
