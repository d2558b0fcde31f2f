import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm import warc

HTML = (
    '<html><head><title>A &amp; B\n C</title><style>p{x:y}</style><script>var a="</p>";</script></head>'
    '<body><!-- gone <p> --><h1>Head</h1><p>one <b>two</b>&nbsp;three<br>four &lt;5&gt;</p>'
    '<a class="x" href="/a?b=1&amp;c=2">link</a></body></html>'
)


def sha(text):
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def records(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return warc.derive(warc.responses(pages, F.lit("2024-01-02T03:04:05Z")))


def test_text_links_and_digests(spark):
    rows = records(spark, [(1, "http://x.org/p", HTML), (2, None, None), (1, "http://x.org/p", HTML)]).collect()
    assert len(rows) == 6
    one = {r.warc_type: r for r in rows if r.page_id == 1}
    text = one["conversion"].block
    assert text == "A & B\nC\nHead\none two three\nfour <5>\nlink"
    about = one["metadata"].block
    assert "title: A & B C\r\n" in about and "outlink: /a?b=1&c=2\r\n" in about
    assert "source-header: Content-Type: text/html; charset=utf-8\r\n" in about
    for r in one.values():
        assert r.block_digest == sha(r.block) and r.source_digest == sha(HTML)
        head, block = r.record.split("\r\n\r\n", 1)
        fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:])
        assert block == r.block and int(fields["Content-Length"]) == len(block.encode())
        assert fields["WARC-Refers-To"] == r.refers_to and fields["WARC-Record-ID"] == r.derived_id
        assert fields["WARC-Date"] == "2024-01-02T03:04:05Z"
    assert one["metadata"].refers_to == one["conversion"].refers_to != one["metadata"].derived_id
    empty = {r.warc_type: r for r in rows if r.page_id == 2}
    assert empty["conversion"].block == "" and empty["conversion"].target_uri == ""


def test_character_references_are_read_once(spark):
    texts = {
        "&copy; &middot; &eacute;&nbsp;&hellip;": "© · é …", "&#8217;&#x2019;&#X2019;&#0039;": "’’’'", "&#146;&#150;": "’–",
        "&amp;lt; &amp;amp;": "&lt; &amp;", "&l&#116;;": "&lt;", "a & b &nosuch; &; &#; &#x; &copy": "a & b &nosuch; &; &#; &#x; &copy",
        "&#0;&#xD800;&#1114112;&#999999999;": "\ufffd" * 4, "&#128512;&NotEqualTilde;": "😀≂̸", "&comma;&colon;&": ",:&", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in texts], "t string")
    got = {r.t: r.d for r in rows.select("t", warc.decoded(F.col("t")).alias("d")).collect()}
    assert got == texts
    assert spark.createDataFrame([(None,)], "t string").select(warc.decoded(F.col("t")).alias("d")).first().d is None


def test_links_in_all_three_forms(spark):
    html = (
        '<a href="/one?a=1&amp;b=2">1</a><A class=x HREF = \'/two "2"\'>2</a><a\nhref=/three id=3>3</a>'
        '<a data-href="/not">x</a><abbr href="/not">x</abbr><a href="">empty</a><a href="/caf&eacute;\n4">4</a>'
    )
    got = spark.createDataFrame([(html,)], "h string").select(warc.links(F.col("h")).alias("l")).first().l
    assert got == ["/one?a=1&b=2", '/two "2"', "/three", "", "/café 4"]


def test_nulls_and_clashing_columns(spark):
    source = spark.createDataFrame(
        [(None, None, None, None, None, "x", 1)],
        "record_id string, target_uri string, date string, http_headers array<string>, payload string, block string, extra int",
    )
    rows = warc.derive(source).collect()
    assert len(rows) == 2 and {r.extra for r in rows} == {1}
    assert all("WARC-Refers-To" not in r.record for r in rows)
    assert warc.derive(source.limit(0)).count() == 0


def test_files_are_records_one_after_the_other(spark, tmp_path):
    rows = records(spark, [(1, "http://x.org/p", HTML), (2, "http://y.org", "<p>é")])
    warc.write(rows, str(tmp_path / "out"))
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("part-*")))
    read = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        length = next(int(x.split(b": ")[1]) for x in head.split(b"\r\n") if x.startswith(b"Content-Length"))
        read.append((head + b"\r\n\r\n" + rest[:length]).decode())
        assert rest[length : length + 4] == b"\r\n\r\n"
        data = rest[length + 4 :]
    assert sorted(read) == sorted(r.record for r in rows.collect())
