import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import secret_scan as s

NAMES = [k.name for k in s.BASE + s.WIDER]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)


def plain_base(text):
    """(start, kind, stop) by the contract's own wording."""
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start string, n_owners int")


def scan(spark, rows):
    found = s.scan(frame(spark, rows), F.col("source"), F.col("doc_id"))
    return found, sorted(((r.doc_id, r.base, r.spans) for r in found.collect()), key=lambda r: (r[0] is None, r[0] or 0))


def texts():
    rng = random.Random(2)
    parts = [
        "password=", "PassWD : '", "token = \"", "api_key=", "APIKEY:", "secret", "=", ":", "'", '"', " ", "  ", "\n", "ab12cd34ef",
        "AKIA", "AKIA1234567890AB", "AKIAAKIA12345678ZZ", "0123456789abcdef", "deadbeef", "é", "\U0001f511", "tokén=", "x", "==",
        "password=secret:abcdefghij", "token=token=abcdefgh", "paſſword=abcdefgh1", "toKen=abcdefgh1", "https://u:hunter22@h/",
        "Bearer abcDEF0123456789xyz=", "ghp_0123456789abcdefABCDEF", "https://x.y/",
    ]
    out = ["", None, " ", "password=short", "password=exactly8", "f" * 31, "f" * 32, "AKIA" + "Z" * 11, "AKIA" + "Z" * 12]
    out += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    out.append("word " * 300_000 + "token=abcdefgh12345 " + "0123456789abcdef" * 4)
    return out


def test_base_spans(spark):
    rows = [(i, t, f"o{i}", "clash", 1) for i, t in enumerate(texts())]
    _, got = scan(spark, rows)
    assert len(got) == len(rows)
    for doc, base, spans in got:
        assert [(x.start, x.kind, x.stop) for x in base] == plain_base(rows[doc][1])
        assert {(x.start, x.kind, x.stop) for x in base} <= {(x.start, x.kind, x.stop) for x in spans}
        assert [(x.start, x.kind) for x in spans] == sorted((x.start, x.kind) for x in spans)


def test_gates_lose_nothing():
    scanner = s.Scanner(s.BASE + s.WIDER)
    for some in (texts(), ["", "", None], [], ["0123456789abcdef" * 2, "x" * 20, "a:", "=b"]):
        array = pa.array(["pad padding", *some, "tail"], pa.string()).slice(1, len(some))
        ungated = []
        for t in some:
            found = []
            for i, k in enumerate(s.BASE + s.WIDER):
                found += [(m.start(), i, m.end()) for m in re.finditer(k.pattern, t or "") if len(m.group(k.group)) >= k.least]
            ungated.append(sorted(found))
        assert [[(x["start"], x["kind"], x["stop"]) for x in one] for one in scanner.find_all(array)] == ungated


def test_owners_and_repositories(spark):
    live, copied, dull = "Zk3vR8qLm2Xw9TtB4nPy", "Qa7sD2fG9hJ4kL0zXcVb", "aaaaaaaaaaaaaaaaaaaa"
    rows = [(i, f"see {live} and {copied}", "one", "", 1) for i in range(5)]
    rows += [(10 + i, f"see {copied} or {dull}", f"o{i}", "", 1) for i in range(3)]
    rows += [(20, f"key {live}x token={live}", "one", "", 1), (21, None, None, "", 1), (None, f"{copied}", None, "", 1)]
    frame_, got = scan(spark, rows + rows[:2])
    assert len(got) == len(rows) + 2 and frame_.columns == ["doc_id", "base", "spans"]
    by = defaultdict(list)
    for doc, _, spans in got:
        by[doc].append([(NAMES[x.kind], x.verdict, x.n_owners, x.n_repositories) for x in spans])
    assert by[3] == [[("opaque", "live", 1, 6)]] and by[0] == by[3] * 2
    assert by[11] == [[]] and by[None] == [[]] and by[21] == [[]]
    # the opaque span inside the assignment is not told again
    assert sorted(by[20][0]) == [("assign", "live", 1, 6), ("opaque", "live", 1, 1)]


@pytest.mark.parametrize("hot", [1, 2, 1024])
def test_hot_values_by_both_ways(spark, monkeypatch, hot):
    monkeypatch.setattr(s, "HOT", hot)
    rng = random.Random(5)
    values = ["".join(rng.choice("abcXYZ0189") for _ in range(24)) for _ in range(6)]
    rows = [(i, " ".join(rng.choices(values, [50, 10, 5, 3, 1, 1], k=3)), f"o{i % 7 if i % 3 else 0}", "", 1) for i in range(120)]
    owners = defaultdict(set)
    for _, text, owner, *_ in rows:
        for v in text.split():
            owners[v].add(owner)
    _, got = scan(spark, rows)
    for doc, _, spans in got:
        want = [v for v in rows[doc][1].split() if len(owners[v]) == 1]
        assert [rows[doc][1][x.start : x.stop] for x in spans] == want


def test_empty_table(spark):
    assert scan(spark, [])[1] == []
