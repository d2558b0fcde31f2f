from pyspark.sql import functions as F

from ledgerloom.llm import url_filters as u
from ledgerloom.llm.components import components

RULES = [("allow", "com/"), ("block", "ex.com/en/"), ("allow", "www.ex.com/en/"), ("block", "net/es/")]


def judged(spark, rows, redirects=None, rules=RULES):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string, host int")
    known = None
    if redirects is not None:
        known = spark.createDataFrame(redirects, "source_url string, target_url string")
    out = u.judge(pages, u.rules_frame(spark, rules), known).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}, len(out)


def page(i, url, html=None):
    return (i, url, html, "clash", 1)


def test_rules_and_parts(spark):
    got, n = judged(
        spark,
        [
            page(1, "http://A.EX.com/en/1?x#y"),
            page(2, "https://www.ex.com/en/é\n/z"),
            page(3, "http://notex.com/en/"),
            page(4, None),
            page(5, "mailto:x"),
            page(6, "http://h.net/es/#://b.com/"),
            page(7, "http://h.org?q=/en/"),
            page(8, ""),
        ],
    )
    assert n == 8
    assert got[1] == ("a.ex.com", "/en/1", "ex.com/en/", "block")
    assert got[2] == ("www.ex.com", "/en/é\n/z", "www.ex.com/en/", "allow")
    assert got[3] == ("notex.com", "/en/", "com/", "allow")
    assert got[4] == got[5] == got[8] == ("", "", None, "allow")
    assert got[6] == ("h.net", "/es/", "net/es/", "block")
    assert got[7] == ("h.org", "", None, "allow")


def test_block_reaches_aliases_and_allow_goes_first(spark):
    canon = '<html><link href="http://b.net/es/1" rel="canonical">'
    turn = "<META http-equiv='refresh' content='0; url=/x'>"
    got, n = judged(
        spark,
        [
            page(1, "http://a.org/1", canon),  # named after a blocked page
            page(2, "http://b.net/es/1#top", None),
            page(3, "https://c.org/y", turn),  # sends on to /x
            page(4, "http://c.org/x", None),  # known alias of a blocked page
            page(5, "http://d.org/1", None),  # its component also holds an allowed page
            page(6, "http://free.com/1", None),
            page(7, "http://e.org/", "<a href='http://b.net/es/1'>no alias</a>"),
            page(1, "http://a.org/1", canon),
        ],
        [
            ("http://c.org/x", "http://b.net/es/9"),
            ("http://d.org/1", "http://b.net/es/7"),
            ("http://free.com/1", "http://d.org/1"),
            (None, "http://d.org/1"),
        ],
    )
    assert n == 8
    assert got[1][3] == "block" and got[1][2] is None
    assert got[2][3] == "block"
    # the blocked address is no page itself, only the end of a known redirect
    assert got[3][3] == got[4][3] == "block"
    assert got[5][3] == "allow" and got[6][3] == "allow" and got[7][3] == "allow"


def test_empty(spark):
    assert judged(spark, [])[1] == 0


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, k) for k in range(501, 560)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(160)]
    edges += [(7, 7), (1, 0), (1, 0)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").union(spark.sql("select null, 5L"))
    got = {r.node: r.root for r in components(df, "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert components(df.where(F.lit(False)), "a", "b").count() == 0
