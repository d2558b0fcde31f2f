"""What staging leaves on disk."""

import os

from pyspark.sql import functions as F

from ledgerloom.operators import labelling
from ledgerloom.plans.statements import process
from ledgerloom.session import DROP_SHUFFLES, settle, shared_folder, stage


def shuffled(spark) -> int:
    found = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def staged(spark) -> set[str]:
    folder = shared_folder(spark)
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_shuffles_end_with_the_table_they_were_for(spark):
    before, setting = shuffled(spark), spark.conf.get(DROP_SHUFFLES)
    counts = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffled(spark) <= before and spark.conf.get(DROP_SHUFFLES) == setting
    assert counts.agg(F.sum("count")).first()[0] == 1000


def test_what_was_staged_on_the_way_is_deleted(spark):
    before = staged(spark)

    def make():
        inner = settle(lambda: stage(spark.range(10), "first").where("id > 2"), "second")
        return inner.unionByName(stage(spark.range(3), "third"))

    assert settle(make, "whole").count() == 10
    assert [name.rpartition("-")[0] for name in staged(spark) - before] == ["whole"]


def test_process_keeps_its_results_only(spark):
    before = staged(spark)
    page = [("a", 1, "Statement of account for the holder of these papers, printed on one leaf. " * 3), ("b", 1, "x")]
    pages = spark.createDataFrame(page, "statement_id string, page_no long, text string")
    rows = [["Date", "Narration", "Debit", "Credit", "Balance"], ["01/02/2003", "tea", "5.00", "", "95.00"], ["02/02/2003", "pay", "", "7.00", "102.00"]]
    cells = spark.createDataFrame(
        [(s, 0, i + 1, r) for s in ("a", None) for i, r in enumerate(rows)], "statement_id string, table_no long, row_no long, cells array<string>"
    )
    words = [("b", 1, "03/02/2003", 0.0), ("b", 1, "POS", 90.0), ("b", 1, "SHOP", 140.0), ("b", 1, "8.00", 200.0), ("b", 1, "44.00", 300.0)]
    boxes = spark.createDataFrame([(*w, 20.0, 12.0, "0.9") for w in words], "statement_id string, page_no long, text string, x double, y double, h double, score string")
    for scans, sizes in ((None, {"a": 2, "b": 0}), (boxes, {"a": 2, "b": 1})):
        result = process(pages, cells, scans, mode=labelling.HEURISTIC, default_year=2003)
        left = {name.rpartition("-")[0] for name in staged(spark) - before}
        assert left == {"ledger", "statements"}
        assert {r.statement_id: r.total_transactions for r in result["statements"].collect()} == sizes
        assert result["ledger"].count() == sum(sizes.values()) and result["anomalies"].count() >= 0
