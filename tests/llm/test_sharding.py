import zlib

import pytest

from ledgerloom.llm import sharding as s


def check(rows, n, shards):
    counts = [0] * shards
    slots = [set() for _ in range(shards)]
    for r in rows:
        counts[r.shard] += 1
        slots[r.shard].add(r.slot)
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    assert all(slots[i] == set(range(counts[i])) for i in range(shards))


@pytest.mark.parametrize("shards", [1, 16])
def test_law_links_and_sizes(spark, shards):
    texts = [f"single {i}" for i in range(700)] + ["hot é"] * 350
    for g in range(40):
        texts += [f"group {g}"] * (2 + g % 7)
    texts += [None, "", None]
    rows = [(i, t, 9, "clash") for i, t in enumerate(texts)]
    rows += [(None, "hot é", 9, "clash"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, hub string")
    out = s.shard_documents(docs, shards).collect()
    check(out, len(rows), shards)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    groups = {}
    for r in out:
        groups.setdefault(r.hub, []).append(r.shard)
    small = [g for g in groups.values() if 1 < len(g) < 50]
    cut = sum(len(g) - max(map(g.count, g)) for g in small)
    assert cut <= 0.1 * sum(map(len, small))
    hot = max(groups.values(), key=len)
    most = sorted((hot.count(x) for x in set(hot)), reverse=True)[:6]
    assert sum(most) >= 0.75 * len(hot)


def test_few_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    check(s.shard_documents(docs).collect(), 3, 16)
    assert s.shard_documents(docs.limit(0)).count() == 0
