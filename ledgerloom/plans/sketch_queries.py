"""Distinct accounts and debit quantiles by month and category: from sketches, and exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sketches
from ..session import stage
from .book_queries import LABELLED, labelled_entries
from .registry import query

QUANTILES = {"median": 0.5, "p95": 0.95}


def _debits(spark, sf_dir) -> DataFrame:
    rows = labelled_entries(spark, sf_dir).where("debit > 0")
    return rows.select(
        "statement_id", "category", F.date_format("txn_date", "yyyy-MM").alias("month"), (F.col("debit") * 100).cast("long").alias("cents")
    )


def sketch_table(spark, sf_dir) -> DataFrame:
    return stage(sketches.sketched(_debits(spark, sf_dir), ["month", "category"], "statement_id", "cents"), "sketches")


@query("spend_sketches")
def q_sketches(spark, sf_dir):
    """Months and categories, categories, and the whole book, each merged from the level below; errors are tested."""
    fine = sketch_table(spark, sf_dir)
    middle = stage(sketches.merged(fine, ["category"]), "sketches")
    levels = [
        fine,
        middle.withColumn("month", F.lit(None).cast("string")),
        sketches.merged(middle, []).withColumns({"month": F.lit(None).cast("string"), "category": F.lit(None).cast("string")}),
    ]
    found = [sketches.estimates(level, ["month", "category"], QUANTILES) for level in levels]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    "distinct_accounts",
    f"""with {LABELLED} select strftime(txn_date, '%Y-%m') as month, category, count(*) as n, count(distinct statement_id) as n_distinct
   from (select l.*, x.category from ledger l join labelled x using (txn_id)) where debit > 0
   group by grouping sets ((1, 2), (2), ())""",
)
def q_distinct(spark, sf_dir):
    """The exact counts beside the sketches: distinct (group, account) first, so no task holds a group."""
    rows = _debits(spark, sf_dir).groupBy("month", "category", "statement_id").agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("string")
    found = None
    for month, category in ((F.col("month"), F.col("category")), (none, F.col("category")), (none, none)):
        once = rows.select(month.alias("month"), category.alias("category"), "statement_id", "n")
        level = once.groupBy("month", "category", "statement_id").agg(F.sum("n").alias("n"))
        level = level.groupBy("month", "category").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"))
        found = level if found is None else found.unionByName(level)
    return found


@query(
    "debit_quantiles",
    f"""with {LABELLED}, d as (select x.category, cast(l.debit * 100 as bigint) as cents from ledger l join labelled x using (txn_id) where l.debit > 0),
   r as (select *, row_number() over (partition by category order by cents) as place, count(*) over (partition by category) as n from d)
   select category, n, max(case when place = cast(ceil(n * 0.5::double) as bigint) then cents end) as median,
    max(case when place = cast(ceil(n * 0.95::double) as bigint) then cents end) as p95 from r group by 1, 2""",
)
def q_quantiles(spark, sf_dir):
    return sketches.exact_quantiles(_debits(spark, sf_dir), "category", "cents", QUANTILES)
