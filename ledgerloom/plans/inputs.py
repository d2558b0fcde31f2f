"""Statement inputs derived from the order and customer tables.

Every account is one statement and every order one ledger row. The same tables are described
in SQL (``LEDGER_SQL``) so that results can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.amounts import MONEY
from ..operators.blocks import block_by_splits, hot_splits, scan

# Sixteen narration shapes of our own: text before and after a 12-digit reference.
NARRATIONS = [
    ("UPI/", "/ZOMATO/dinner order/DR"),
    ("POS ", " GREEN KIRANA STORE"),
    ("NEFT CR ", " ACME LTD PAYROLL"),
    ("ATM WDL ", " CITY BRANCH"),
    ("ACH DR ", " HOME LOAN EMI"),
    ("IMPS/", "/FRIEND SHARE"),
    ("BILLDESK ", " ELECTRICITY"),
    ("UPI/", "/UBER TRIP/Payment"),
    ("RTGS DR ", " VENDOR SETTLEMENT"),
    ("ACH DR ", " GROWW SIP"),
    ("SMS CHG ", " QTR"),
    ("CHQ ", " INWARD CLG"),
    ("POS ", " APOLLO PHARMACY"),
    ("", " NETFLIX PLAN"),
    ("UPI/", "/AMAZON/Ref"),
    ("MISC ENTRY ", ""),
]

_TEMPLATES = ",\n".join(f" ({k},'{head}','{tail}')" for k, (head, tail) in enumerate(NARRATIONS))

LEDGER_SQL = f"""tpl(k, head, tail) as (values
{_TEMPLATES}),
base as (
 select o_custkey as statement_id, o_orderkey as txn_id, cast(o_orderdate as date) as txn_date,
        cast(o_totalprice as decimal(18,2)) as amt,
        case when o_orderstatus = 'F' then 1 else 0 end as is_cr,
        cast(c_acctbal as decimal(18,2)) as open_bal,
        row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as seq,
        count(*) over (partition by o_custkey) as n
 from orders join customer on o_custkey = c_custkey),
ledger as (
 select statement_id, txn_id,
        case when statement_id % 3 = 0 then n - seq + 1 else seq end as row_no, txn_date,
        concat(head, lpad(cast(txn_id as varchar), 12, '0'), tail) as description,
        cast(case when is_cr = 0 then amt else 0 end as decimal(18,2)) as debit,
        cast(case when is_cr = 1 then amt else 0 end as decimal(18,2)) as credit,
        cast(open_bal + sum(case when is_cr = 1 then amt else -amt end)
               over (partition by statement_id order by seq
                     rows between unbounded preceding and current row)
             + case when txn_id % 97 = 0 then 25 else 0 end as decimal(18,2)) as balance,
        case when is_cr = 1 then 'CREDIT' else 'DEBIT' end as type
 from base join tpl on k = txn_id % 16)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narration(txn_id: Column) -> Column:
    """The narration of an order: one of the shapes above around its number."""
    shape = (txn_id % len(NARRATIONS) + 1).cast("int")
    heads = F.array(*[F.lit(h) for h, _ in NARRATIONS])
    tails = F.array(*[F.lit(t) for _, t in NARRATIONS])
    return F.concat(
        F.element_at(heads, shape), F.lpad(txn_id.cast("string"), 12, "0"), F.element_at(tails, shape)
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a scan with fewer splits than cores, spread over the cores.

    The label expressions work long on few bytes. A large table has more splits than cores
    and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as unnumbered ledger entries: one narrow scan, no shuffle."""
    amount = F.col("o_totalprice").cast(MONEY)
    credit = F.col("o_orderstatus") == "F"
    zero = F.lit(0).cast(MONEY)
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("statement_id"),
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_orderdate").cast("date").alias("txn_date"),
        narration(F.col("o_orderkey")).alias("description"),
        F.when(credit, zero).otherwise(amount).alias("debit"),
        F.when(credit, amount).otherwise(zero).alias("credit"),
        F.when(credit, F.lit("CREDIT")).otherwise(F.lit("DEBIT")).alias("type"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed ledger: position and running balance of every order in its account.

    Accounts too large for one task are cut at quantiles of (day, order number); positions
    and balances are carried across the cuts.
    """
    when = F.shiftleft(F.unix_date("txn_date").cast("long"), 40) + F.col("txn_id")
    rows = entries(spark, sf_dir)
    cut = hot_splits(rows.select("statement_id", when.alias("at")), "statement_id", F.col("at"))
    placed = block_by_splits(rows.withColumn("at", when), "statement_id", F.col("at"), cut)
    accounts = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("statement_id"), F.col("c_acctbal").cast(MONEY).alias("open_bal")
    )
    one = F.lit(1).cast("long")
    numbered = scan(
        placed,
        ["statement_id"],
        ["at"],
        sums={"seq": one, "moved": F.col("credit") - F.col("debit")},
        whole={"n": one},
        facts=accounts,
    ).where(F.col("open_bal").isNotNull())
    fault = F.when(F.col("txn_id") % 97 == 0, F.lit(25)).otherwise(F.lit(0))
    return numbered.select(
        "statement_id",
        "txn_id",
        F.when(F.col("statement_id") % 3 == 0, F.col("n") - F.col("seq") + 1)
        .otherwise(F.col("seq"))
        .alias("row_no"),
        "txn_date",
        "description",
        "debit",
        "credit",
        (F.col("open_bal") + F.col("moved") + fault).cast(MONEY).alias("balance"),
        "type",
    )
