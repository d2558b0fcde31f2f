"""Byte-level BPE by recursive queries: encoding and decoding with the ranks of a tokenizer file.

Every Spark task opens a DuckDB of its own, in memory, with the merge table. The distinct
pieces of a chunk of texts become rows of (piece, position, token); a recursive query joins
neighbouring rows with the merge table and contracts the pair of lowest rank of every piece
until no pair can be merged. Ordered aggregation over the tokens gives the text back.

A long piece is cut into segments that are contracted on their own, and its tokens are then
checked where segments meet. A row of tokens is what contraction gives if any two neighbours,
contracted alone, give themselves: the first contraction across a border would also happen
between the two tokens beside it. Where two do not, the tokens around the border are contracted
anew together, with ever more of them, until all borders hold.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from .common import pieces

# Bytes of one recursive query, and of the pieces that stay known from one chunk to the next (they
# are forgotten together when there are more).
QUERY_BYTES = 256 << 10
KNOWN_BYTES = 8 << 20
# Longer pieces are cut into segments of so many bytes; tokens on both sides of a border that are
# contracted anew at first.
SEGMENT = 48
REACH = 4
RESULT = "n_tokens long, ids string, decoded binary"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"

# One step: the pairs of neighbouring tokens join the merge table, and each piece contracts the
# leftmost of its lowest rank. Pieces without a pair leave the recursion.
_MERGE = """
with recursive state(piece, tokens, going) as (
  select piece, list(token order by pos), true from start group by piece
 union all
  (with pairs as (
     select s.piece, m.token * 4294967296 + s.pos as rated
     from (select piece, tokens, unnest(range(1, len(tokens))) as pos from state where going) s
     join merges m on m.lhs = s.tokens[s.pos] and m.rhs = s.tokens[s.pos + 1]),
   lowest as (
     select piece, cast(min(rated) // 4294967296 as integer) as best, min(rated) % 4294967296 as pos
     from pairs group by piece)
   select s.piece,
          case when l.best is null then s.tokens
               else list_concat(s.tokens[:l.pos - 1], [l.best], s.tokens[l.pos + 2:]) end,
          l.best is not null
   from state s left join lowest l using (piece) where s.going)
)
select tokens from state where not going order by piece
"""

# Bytes stand as the characters U+0000 to U+00FF, so that text functions can join them.
_DECODE = """
select doc, string_agg(bytes, '' order by pos) as text from encoded join vocabulary using (token)
group by doc order by doc
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tokenizer file: a line for each token, base64 bytes and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge_rows(ranks: dict[bytes, int]) -> pa.Table:
    """Every pair of tokens whose bytes together are a token: lhs, rhs, token."""
    left, right, merged = [], [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                merged.append(rank)
    return pa.table({"lhs": pa.array(left, pa.int32()), "rhs": pa.array(right, pa.int32()), "token": pa.array(merged, pa.int64())})


def token_rows(tokens: np.ndarray, sizes: np.ndarray, name: str) -> pa.Table:
    """(name, pos, token): tokens of lists that stand one after the other."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    return pa.table(
        {
            name: np.repeat(np.arange(len(sizes), dtype=np.int32), sizes),
            "pos": (np.arange(len(tokens)) - starts).astype(np.int32),
            "token": tokens.astype(np.int32),
        }
    )


class Codec:
    """The DuckDB of one task: encodes and decodes chunks of texts."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        # nothing spills to a worker's own folder: queries are bounded in bytes instead
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self._create("merges", merge_rows(self.ranks))
        words = {
            "token": pa.array(self.ranks.values(), pa.int32()),
            "bytes": pa.array([t.decode("latin-1") for t in self.ranks], pa.string()),
        }
        self._create("vocabulary", pa.table(words))
        self.byte_tokens = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.token_texts = list(map(str, range(max(self.ranks.values()) + 1)))
        # piece -> its number; for each number the tokens as text, their count, the decoded bytes
        self.numbers: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts: list[int] = []
        self.bytes: list[bytes] = []
        self.held = 0

    def _create(self, name: str, rows: pa.Table) -> None:
        self.con.register("rows", rows)
        self.con.execute(f"create or replace table {name} as select * from rows")
        self.con.unregister("rows")

    def merge(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all pieces one after the other, and how many each piece has."""
        tokens, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        ends = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)))
        cuts = np.flatnonzero(np.diff(ends // QUERY_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(raws)], strict=True):
            raw = raws[a:b]
            if raw:
                lengths = np.fromiter(map(len, raw), np.int64, len(raw))
                singles = self.byte_tokens[np.frombuffer(b"".join(raw), np.uint8)]
                self._create("start", token_rows(singles, lengths, "piece"))
                lists = self.con.sql(_MERGE).to_arrow_table()["tokens"].combine_chunks()
                tokens.append(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
                sizes.append(np.diff(lists.offsets.to_numpy()).astype(np.int64))
        return np.concatenate(tokens), np.concatenate(sizes)

    def _merged(self, raws: list[bytes]) -> list[list[int]]:
        """The tokens of each piece; equal pieces are contracted once."""
        kinds = sorted(set(raws))
        tokens, sizes = self.merge(kinds)
        ends = np.cumsum(sizes).tolist()
        flat = tokens.tolist()
        found = {k: flat[a:b] for k, a, b in zip(kinds, [0, *ends], ends, strict=False)}
        return [found[r] for r in raws]

    def merge_long(self, raw: bytes) -> list[int]:
        """The tokens of one long piece, from segments and the borders between them."""
        parts = self._merged([raw[i : i + SEGMENT] for i in range(0, len(raw), SEGMENT)])
        tokens = [t for part in parts for t in part]
        borders = np.cumsum([len(part) for part in parts])[:-1].tolist()
        reach = REACH
        while borders:
            sides = [(tokens[i - 1], tokens[i]) for i in borders]
            alone = self._merged([self.token_bytes[a] + self.token_bytes[b] for a, b in sides])
            open_ = [i for i, pair, got in zip(borders, sides, alone, strict=True) if got != list(pair)]
            spans: list[list[int]] = []
            for i in open_:
                begin, end = max(0, i - reach), min(len(tokens), i + reach)
                if spans and begin <= spans[-1][1]:
                    spans[-1][1] = end
                else:
                    spans.append([begin, end])
            anew = self._merged([b"".join(map(self.token_bytes.__getitem__, tokens[a:b])) for a, b in spans])
            out, borders, done = [], [], 0
            for (a, b), found in zip(spans, anew, strict=True):
                out += tokens[done:a]
                if out:
                    borders.append(len(out))
                out += found
                if b < len(tokens):
                    borders.append(len(out))
                done = b
            tokens, reach = out + tokens[done:], 2 * reach
        return tokens

    def decode(self, tokens: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The bytes of lists of tokens that stand one after the other."""
        self._create("encoded", token_rows(tokens, sizes, "doc"))
        found = self.con.sql(_DECODE).to_arrow_table()
        out = [b""] * len(sizes)
        for doc, text in zip(found["doc"].to_pylist(), found["text"].to_pylist(), strict=True):
            out[doc] = text.encode("latin-1")
        return out

    def _learn(self, new: list[str]) -> None:
        """Encode new pieces and decode their tokens; a piece that is a token is that token."""
        whole, short, long = {}, [], []
        for piece in new:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            if rank is not None:
                whole[piece] = rank
            else:
                (long if len(raw) > SEGMENT else short).append((piece, raw))
        longs = [np.array(self.merge_long(raw), np.int64) for _, raw in long]
        found = [
            (np.array(list(whole.values()), np.int64), np.ones(len(whole), np.int64)),
            self.merge([raw for _, raw in short]),
            (np.concatenate([*longs, np.empty(0, np.int64)]), np.array([len(x) for x in longs], np.int64)),
        ]
        tokens, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        for piece in [*whole, *(p for p, _ in short), *(p for p, _ in long)]:
            self.numbers[piece] = len(self.numbers)
            self.held += len(piece)
        texts = list(map(self.token_texts.__getitem__, tokens.tolist()))
        ends = np.cumsum(sizes).tolist()
        self.texts += [" ".join(texts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        self.counts += sizes.tolist()
        self.bytes += self.decode(tokens, sizes)

    def code(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text: number of tokens, tokens joined by spaces, bytes decoded from them.

        Tokens never cross pieces, so those of a text are the tokens of its pieces in order, and
        so are the bytes; every distinct piece is encoded and decoded once.
        """
        cut = [self.pattern.findall(t) for t in texts]
        if self.held > KNOWN_BYTES:
            self.numbers, self.texts, self.counts, self.bytes, self.held = {}, [], [], [], 0
        new = {p for one in cut for p in one}.difference(self.numbers)
        if new:
            self._learn(sorted(new))
        for one in cut:
            at = [self.numbers[p] for p in one]
            yield (
                sum(map(self.counts.__getitem__, at)),
                " ".join(map(self.texts.__getitem__, at)),
                b"".join(map(self.bytes.__getitem__, at)),
            )


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def coded(text: Column, path: str, pattern: str, *, digests: bool = False) -> Column:
    """A struct of n_tokens, ids (decimal, joined by spaces) and the bytes decoded from the ids.

    With ``digests`` the last two are SHA-256 in lower-case hex, so that little leaves Python.
    A null or empty text has no tokens and decodes to no bytes. ``path`` is the file of ranks,
    ``pattern`` cuts a text into the pieces that are encoded separately.
    """

    @pandas_udf(DIGESTS if digests else RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(path, pattern)
        names = [column.split()[0] for column in (DIGESTS if digests else RESULT).split(", ")]
        for batch in batches:
            for some in pieces(batch):
                rows = codec.code([t or "" for t in some])
                if digests:
                    rows = ((n, _sha256(ids.encode()), _sha256(back)) for n, ids, back in rows)
                yield pd.DataFrame(list(rows), columns=names)

    return run.asNondeterministic()(text)  # evaluated once, also where several columns read it


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of token lists written as by ``coded``; null for null."""

    @pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(path, pattern)
        for batch in batches:
            for some in pieces(batch):
                lists = [np.array((one or "").split(), np.int64) for one in some]
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                back = codec.decode(np.concatenate([*lists, np.empty(0, np.int64)]), sizes)
                yield pd.Series([None if one is None else b for one, b in zip(some, back, strict=True)], dtype=object)

    return run(ids)
