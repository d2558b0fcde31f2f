"""What must not grow faster than the input: memory of a task, work for a row."""

from ledgerloom.operators import routing


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_routes_sort_no_rows_and_broadcast_no_documents(spark):
    docs = spark.range(2000).selectExpr("id AS statement_id", "id % 4 <> 1 AS is_text_based", "false AS text_error")
    rows = spark.range(5000).selectExpr("id % 1500 AS statement_id", "id AS txn_id")
    routes = routing.choose_routes(docs, rows, rows)
    text = plan(routing.routed_rows(routes, rows, rows))
    assert "ShuffledHashJoin" in text
    for word in ("SortMergeJoin", "BroadcastHashJoin", "Sort ["):
        assert word not in text


def test_equal_texts_are_fitted_once(spark):
    from ledgerloom.operators import model

    rows = spark.range(600).selectExpr(
        "element_at(array('Food', 'Rent', 'Pay'), cast(id % 3 as int) + 1) AS category",
        "concat('NEFT ', lpad(id, 12, '0'), element_at(array(' DINNER', ' FLAT DUES', ' MONTHLY PAY'), cast(id % 3 as int) + 1), if(id % 50 = 0, ' LATE', '')) AS description",
    )
    texts = model.distinct_texts(rows)
    assert texts.count() == 6 and texts.agg({model.COPIES: "sum"}).first()[0] == 600
    bayes = model.fit(rows, kind="naive_bayes")
    assert bayes.train_samples == 600
    # sums of weights over all rows: every copy of the plain and of the late texts counts
    weights = model.tfidf(rows.selectExpr("monotonically_increasing_id() AS k", "description"), "k")
    whole = weights.agg({"weight": "sum"}).first()[0]
    grouped = model.tfidf(texts.selectExpr("*", "monotonically_increasing_id() AS k"), "k")
    copies = texts.selectExpr("monotonically_increasing_id() AS k", model.COPIES)
    assert abs(grouped.join(copies, "k").selectExpr(f"sum(weight * {model.COPIES})").first()[0] - whole) < 1e-6
    slopes = model.gradient(model.fit(rows), rows, "key").collect()
    assert max(abs(r.gradient) for r in slopes) <= 1e-5


def test_many_statements_are_settled_without_a_group_each(spark, tmp_path):
    from pathlib import Path

    from ledgerloom.streaming import running_audit

    big = 2**60 + 1
    rows = spark.range(900).selectExpr(
        "id % 300 AS statement_id", f"{big} + id AS txn_id", "id div 300 + 1 AS row_no",
        *[f"CAST({v} AS decimal(18,2)) AS {c}" for c, v in (("balance", "100 + id div 300"), ("debit", 0), ("credit", 1))],
    )
    landing, sink, log = (f"{tmp_path}/{n}" for n in ("landing", "sink", "log"))
    for part in ("row_no <> 2", "row_no = 2 AND statement_id <> 7", "row_no = 2 AND statement_id = 7"):
        rows.where(part).write.mode("append").parquet(landing)
        running_audit.settle_stream(spark, landing, sink, log, schema=rows.schema)
    got = running_audit.verdicts(spark, sink)
    assert got.count() == 900 and got.where("balance_verified").count() == 900
    assert {r.txn_id for r in got.collect()} == {big + i for i in range(900)}
    assert not Path(log, "state").exists()  # no store with a group for every statement
    assert len(list(Path(log, "ranges", "version=2").glob("_part=*"))) == 1  # one statement: one part


def test_a_box_is_compared_with_near_lines_only(spark):
    from ledgerloom.operators import boxes

    rows = [(1, 1, f"w{y}-{x}", float(x), float(y * 30 + x % 3), 12.0, "0.9") for y in range(20) for x in range(4)]
    df = spark.createDataFrame(rows, "statement_id long, page_no long, text string, x double, y double, h double, score string")
    pages = boxes.boxes_to_pages(df)
    assert pages.first().text.split("\n") == [boxes.WORD_GAP.join(f"w{y}-{x}" for x in range(4)) for y in range(20)]
    held = df.selectExpr("struct(y, x, h, text) AS b").groupBy().agg({"b": "collect_list"}).toDF("boxes")
    cut = held.selectExpr("array_sort(boxes) AS boxes").selectExpr(f"transform({boxes._STRETCHES}, s -> size(s)) AS n").first().n
    assert cut == [4] * 20


def test_amounts_and_plain_words_are_not_searched_for_dates(spark):
    from ledgerloom.functions import dates

    texts = ["1,234.56", "-12,345.67", "100.25", "UPI/000000000123/ZOMATO", "12.05", "May 3", "xmay 3", "3-4", "05 Mar 95"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and str(r[0]) for r in df.select(dates.parse_date("t", default_year=2003)["date"]).collect()]
    assert got == [None, None, None, None, "2003-12-05", "2003-05-03", None, "2003-03-04", "1995-03-05"]
    cheap = f"t rlike r'{dates.NO_DATE}' OR NOT (t rlike r'{dates.MONTH_BEGIN}' OR t rlike r'{dates.TWO_NUMBERS}')"
    assert [r.c for r in df.selectExpr(f"{cheap} AS c").collect()] == [True] * 4 + [False] * 5


def test_empty_cells_are_not_profiled_but_their_columns_count(spark):
    from ledgerloom.operators import tables

    cells = [["x"], ["", "01/02/2024", " ", "5.00", None], ["", "02/02/2024", "", "6.00", ""], [""]]
    df = spark.createDataFrame([("s", 0, i + 1, c) for i, c in enumerate(cells)], "statement_id string, table_no long, row_no long, cells array<string>")
    roles = tables.profile_columns(df, default_year=2024).first().roles
    assert (roles.date, roles.desc, roles.balance) == (1, 3, -1)
    empty = spark.createDataFrame([("s", 0, i + 1, ["", ""]) for i in range(3)], df.schema)
    assert tables.profile_columns(empty, default_year=2024).first().roles.desc == 0
    assert "posexplode" not in plan(tables.profile_columns(df, default_year=2024))
