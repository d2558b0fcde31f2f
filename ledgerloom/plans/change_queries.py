"""Heavy hitters over the book, and sums that follow manual categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import analytics, heavy, increments
from ..operators import labelling as lab
from ..session import stage
from .book_queries import _NAMES14, LABELLED, entries, labelled_entries
from .io_queries import fresh_folder
from .label_sql import merchant_steps
from .registry import amount, query


@query(
    "heavy_merchants",
    f"""with {merchant_steps('ledger', 'txn_id')}
   select merchant, cast(sum(debit) as double) as total_amount, count(*) as count from ledger join merchants using (txn_id)
   where debit > 0 and merchant is not null and merchant <> '' group by 1 order by sum(debit) desc, merchant limit 8""",
)
def q_heavy_merchants(spark, sf_dir):
    rows = lab.with_channel_and_merchant(entries(spark, sf_dir))
    paid = analytics.with_merchant(rows.where("debit > 0").select("merchant", "debit"))
    found = heavy.heavy_hitters(paid, "merchant", "debit", analytics.TOP_MERCHANTS)
    return found.select("merchant", amount("total").alias("total_amount"), "count")


@query(
    "heavy_narrations",
    """with said as (select description, sum(debit + credit) as total, count(*) as n from ledger group by 1)
   select description, cast(total as double) as total_amount, n as count from said order by total desc, description limit 50""",
)
def q_heavy_narrations(spark, sf_dir):
    """Every narration is a key of its own here: far more keys than counters, and a long tail to leave out."""
    rows = entries(spark, sf_dir).select("description", (F.col("debit") + F.col("credit")).alias("moved"))
    found = heavy.heavy_hitters(rows, "description", "moved", 50)
    return found.select("description", amount("total").alias("total_amount"), "count")


# Two changes: some entries get a manual category, some of them another one later.
FIRST, SECOND = 41, 82


def _renamed(rows: DataFrame, every: int, shift: int) -> DataFrame:
    names = F.array(*[F.lit(c) for c in K.CATEGORIES])
    chosen = F.element_at(names, ((F.col("txn_id") + shift) % 14 + 1).cast("int"))
    return rows.where(F.col("txn_id") % every == 0).select("txn_id", chosen.alias("category"))


@query(
    "incremental_categories",
    f"""with {LABELLED}, named as (select *, case when txn_id % {SECOND} = 0 then ({_NAMES14})[(txn_id + 5) % 14 + 1]
     when txn_id % {FIRST} = 0 then ({_NAMES14})[txn_id % 14 + 1] else category end as final from labelled)
   select statement_id, final as category, cast(sum(debit) as double) as total_amount, count(*) as count
   from named where debit > 0 group by 1, 2""",
)
def q_incremental(spark, sf_dir):
    """Loaded once, then two changes as signed rows, the second one delivered twice."""
    rows = labelled_entries(spark, sf_dir).where("debit > 0")
    ledger = stage(rows.select("txn_id", "statement_id", "category", "confidence", "classification_method", "debit"), "labelled")
    store = increments.Store(spark, fresh_folder(spark, "category-sums"), ["statement_id", "category"], ["debit"])
    store.load(ledger)
    first, second = _renamed(ledger, FIRST, 0), _renamed(ledger, SECOND, 5)
    old = ledger.join(first.select("txn_id"), "txn_id", "left_semi")
    renamed = lab.apply_overrides(old, first)
    store.apply(1, old, renamed)
    again = renamed.join(second.select("txn_id"), "txn_id", "left_semi")
    for _ in range(2):
        store.apply(2, again, lab.apply_overrides(again, second))
    return store.read().select("statement_id", "category", amount("debit").alias("total_amount"), F.col("n").alias("count"))
