"""What the physical plans must and must not contain."""

import re

import pytest

from ledgerloom.operators import analytics, audit
from ledgerloom.plans import inputs
from ledgerloom.plans.book_queries import labelled_entries
from ledgerloom.plans.catalog import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


NATIVE = [
    "category_summary", "top_merchants", "monthly_trend", "classify_heuristic", "audit_rows", "clean_amount",
    "parse_date", "detect_issuer", "account_no", "doc_typing", "tfidf", "report_cube",
]


@pytest.mark.parametrize("name", NATIVE)
def test_core_plans_stay_on_the_jvm(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    for word in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text


def test_labels_need_no_shuffle(spark, small):
    from ledgerloom.operators.labelling import label_by_rules

    assert "Exchange" not in plan(label_by_rules(inputs.entries(spark, small)))


def test_filters_and_columns_reach_the_scan(spark, small):
    text = plan(inputs.entries(spark, small).where("txn_id > 100").select("txn_id", "debit"))
    assert "GreaterThan(o_orderkey,100)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_orderstatus", "o_totalprice"}


def test_audit_shuffles_the_ledger_once_per_branch(spark, small):
    rows = spark.read.parquet(f"{small}/orders.parquet").selectExpr(
        "o_custkey AS statement_id", "o_orderkey AS row_no", "CAST(o_totalprice AS decimal(18,2)) AS balance",
        "CAST(0 AS decimal(18,2)) AS debit", "CAST(1 AS decimal(18,2)) AS credit",
    )
    text = plan(audit.audit(rows))
    # rows and votes by (statement, block), votes by statement, verdicts back by (statement, block)
    assert text.count("Exchange hashpartitioning(statement_id") <= 5
    assert text.count("Exchange hashpartitioning(statement_id#") - text.count(", block#") <= 2


def test_totals_of_an_audit_need_no_join(spark, small):
    rows = spark.read.parquet(f"{small}/orders.parquet").selectExpr(
        "o_custkey AS statement_id", "o_orderkey AS row_no", "CAST(o_totalprice AS decimal(18,2)) AS balance",
        "CAST(0 AS decimal(18,2)) AS debit", "CAST(1 AS decimal(18,2)) AS credit",
    )
    text = plan(audit.audited_totals(rows))
    assert "Join" not in text and text.count("Exchange hashpartitioning(statement_id") == 2


def test_top_merchants_are_limited_before_the_shuffle(spark, small):
    assert "WindowGroupLimit" in plan(analytics.top_merchants(labelled_entries(spark, small)))
