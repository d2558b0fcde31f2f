"""Queries over the typed ledger: labels, summaries, audit, filters and report layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.labels import channel, merchant, money_directions, token_category, word_category
from ..functions.text import normalize_narration
from ..operators import analytics, audit
from ..operators import labelling as lab
from ..sources import reports
from . import inputs
from .inputs import ledger, spread, table
from .label_sql import (
    AUDIT_STEPS, channel_case, labelled_steps, merchant_steps, quoted, token_case, word_case,
)
from .registry import amount, iso, query

LABELLED = labelled_steps()
CREDIT, DEBIT = "(credit > 0 or type = 'CREDIT')", "(debit > 0 or type = 'DEBIT')"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(inputs.entries(spark, sf_dir), "txn_id")


def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lab.label_by_rules(entries(spark, sf_dir))


# ---- labels -----------------------------------------------------------------------------

@query("channel", f"select txn_id, {channel_case('description')} as channel from ledger")
def q_channel(spark, sf_dir):
    return entries(spark, sf_dir).select("txn_id", channel(F.col("description")).alias("channel"))


@query("merchant", f"with {merchant_steps('ledger', 'txn_id')} select txn_id, merchant from merchants")
def q_merchant(spark, sf_dir):
    return entries(spark, sf_dir).select("txn_id", merchant(F.col("description")).alias("merchant"))


@query(
    "classify_tokens",
    f"select txn_id, {token_case('lower(description)', CREDIT)} as category from ledger",
)
def q_tokens(spark, sf_dir):
    rows = entries(spark, sf_dir)
    _, is_credit = money_directions(F.col("debit"), F.col("credit"), F.col("type"))
    return rows.select("txn_id", token_category(F.lower("description"), is_credit).alias("category"))


@query(
    "classify_rules",
    f"select txn_id, {word_case('lower(description)', DEBIT, CREDIT)} as category from ledger",
)
def q_rules(spark, sf_dir):
    rows = entries(spark, sf_dir)
    is_debit, is_credit = money_directions(F.col("debit"), F.col("credit"), F.col("type"))
    return rows.select(
        "txn_id", word_category(F.lower("description"), is_debit, is_credit).alias("category")
    )


@query(
    "classify_heuristic",
    f"with {LABELLED} select txn_id, category, sub_category, confidence from labelled",
)
def q_heuristic(spark, sf_dir):
    return labelled_entries(spark, sf_dir).select("txn_id", "category", "sub_category", "confidence")


NORMALIZED_SQL = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({c}), '\b\d{{6,}}\b', ' ', 'g'), "
    r"'[/\\:\-_#@.]', ' ', 'g'), '\b\d+\b', ' ', 'g'), '\s+', ' ', 'g'))"
)


@query(
    "normalize_text",
    f"select txn_id, {NORMALIZED_SQL.format(c='description')} as text from ledger",
)
def q_normalize(spark, sf_dir):
    return entries(spark, sf_dir).select("txn_id", normalize_narration(F.col("description")).alias("text"))


# Chat turns are free text in many shapes: the same label expressions over whole turns.
TURNS_SQL = """turns as (select conv_id * 100000 + turn as txn_id, text as description,
   cast(length(text) as decimal(18,2)) as debit, cast(0 as decimal(18,2)) as credit, 'DEBIT' as type
   from conversations)"""


@query(
    "label_free_text",
    f"with {TURNS_SQL}, {labelled_steps('turns')} select txn_id, channel, category, confidence from labelled",
    ledger=False,
)
def q_free_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("txn_id"),
        F.col("text").alias("description"),
        F.length("text").cast("decimal(18,2)").alias("debit"),
        F.lit(0).cast("decimal(18,2)").alias("credit"),
        F.lit("DEBIT").alias("type"),
    )
    return lab.label_by_rules(turns).select("txn_id", "channel", "category", "confidence")


def stub_scores(rows: DataFrame) -> DataFrame:
    """Model scores that SQL can repeat: category and confidence from the transaction number."""
    names = F.array(*[F.lit(c) for c in K.CATEGORIES[:13]])
    return rows.withColumn(
        "ml_category", F.element_at(names, (F.col("txn_id") % 13 + 1).cast("int"))
    ).withColumn("ml_confidence", (F.col("txn_id") % 100) / 100)


_NAMES13 = "[" + ", ".join(quoted(c) for c in K.CATEGORIES[:13]) + "]"
SCORED = f"""{LABELLED}, scored as (select *, ({_NAMES13})[txn_id % 13 + 1] as ml_category,
   (txn_id % 100) / 100.0 as ml_confidence from labelled),
hybrid as (select *, confidence >= 0.9 or (not ml_confidence >= 0.7 and confidence >= ml_confidence) as by_rule from scored)"""


@query(
    "hybrid",
    f"""with {SCORED} select txn_id, case when by_rule then category else ml_category end as category,
   case when by_rule then sub_category end as sub_category,
   cast(case when by_rule then confidence else ml_confidence end as double) as confidence,
   case when by_rule then '{K.METHOD_HYBRID_RULES}' else '{K.METHOD_HYBRID_MODEL}' end as classification_method
   from hybrid""",
)
def q_hybrid(spark, sf_dir):
    scored = lab.rule_labels(stub_scores(entries(spark, sf_dir)), "rule_")
    return lab.combine(scored, lab.HYBRID).select(
        "txn_id", "category", "sub_category", "confidence", "classification_method"
    )


@query(
    "mode_dispatch",
    f"""with {SCORED} select txn_id, 'rules' as mode, category, confidence, '{K.METHOD_HEURISTIC_MODE}' as classification_method from scored
   union all select txn_id, 'model', ml_category, cast(ml_confidence as double), '{K.METHOD_ML_MODE}' from scored
   union all select txn_id, 'other', case when by_rule then category else ml_category end,
     cast(case when by_rule then confidence else ml_confidence end as double),
     case when by_rule then '{K.METHOD_HYBRID_RULES}' else '{K.METHOD_HYBRID_MODEL}' end from hybrid""",
)
def q_modes(spark, sf_dir):
    scored = lab.rule_labels(stub_scores(entries(spark, sf_dir)), "rule_")
    parts = [("rules", lab.HEURISTIC), ("model", lab.ML), ("other", "anything else")]
    frames = [
        lab.combine(scored, mode).select(
            "txn_id", F.lit(name).alias("mode"), "category", "confidence", "classification_method"
        )
        for name, mode in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(
    "reclassify",
    f"""with {LABELLED} select txn_id, category, sub_category, confidence,
   '{K.METHOD_HEURISTIC_MODE}' as classification_method from labelled""",
)
def q_reclassify(spark, sf_dir):
    # an existing ledger labelled under another mode first, then labelled again
    before = lab.combine(lab.rule_labels(stub_scores(entries(spark, sf_dir)), "rule_"), lab.ML)
    return lab.classify(before, lab.HEURISTIC).select(
        "txn_id", "category", "sub_category", "confidence", "classification_method"
    )


_NAMES14 = "[" + ", ".join(quoted(c) for c in K.CATEGORIES) + "]"


@query(
    "apply_overrides",
    f"""with {LABELLED} select txn_id,
   case when txn_id % 41 = 0 then ({_NAMES14})[txn_id % 14 + 1] else category end as category,
   cast(case when txn_id % 41 = 0 then 1.0 else confidence end as double) as confidence,
   case when txn_id % 41 = 0 then '{K.METHOD_OVERRIDE}' else '{K.METHOD_HEURISTIC_MODE}' end as classification_method
   from labelled""",
)
def q_overrides(spark, sf_dir):
    rows = labelled_entries(spark, sf_dir)
    names = F.array(*[F.lit(c) for c in K.CATEGORIES])
    overrides = table(spark, sf_dir, "orders").where("o_orderkey % 41 = 0").select(
        F.col("o_orderkey").alias("txn_id"),
        F.element_at(names, (F.col("o_orderkey") % 14 + 1).cast("int")).alias("category"),
    )
    return lab.apply_overrides(rows, overrides).select(
        "txn_id", "category", "confidence", "classification_method"
    )


# ---- summaries --------------------------------------------------------------------------

@query(
    "totals",
    """select statement_id, cast(sum(debit) as double) as total_debits, cast(sum(credit) as double) as total_credits,
   cast(sum(credit) - sum(debit) as double) as net_cash_flow, count(*) as transaction_count,
   coalesce(cast(sum(debit) filter (debit > 0) as double) / nullif(count(*) filter (debit > 0), 0), 0) as avg_debit
   from ledger group by 1""",
)
def q_totals(spark, sf_dir):
    return analytics.totals(entries(spark, sf_dir)).select(
        "statement_id", amount("total_debits").alias("total_debits"),
        amount("total_credits").alias("total_credits"), amount("net_cash_flow").alias("net_cash_flow"),
        "transaction_count", "avg_debit",
    )


@query(
    "category_summary",
    f"""with {LABELLED}, per as (select statement_id, category, sum(debit) as s, count(*) as n from labelled
   where debit > 0 group by 1, 2)
   select statement_id, category, cast(s as double) as total_amount, n as count,
   round(cast(s as double) * 100 / cast(sum(s) over (partition by statement_id) as double), 1) as percentage from per""",
)
def q_category(spark, sf_dir):
    return analytics.category_summary(labelled_entries(spark, sf_dir)).select(
        "statement_id", "category", amount("total_amount").alias("total_amount"), "count", "percentage"
    )


@query(
    "channel_summary",
    f"""with per as (select statement_id, {channel_case('description')} as channel, sum(debit) as s, count(*) as n
   from ledger group by 1, 2),
   tot as (select *, sum(s) over (partition by statement_id) as t from per)
   select statement_id, channel, cast(s as double) as total_amount, n as count,
   least(round(cast(s as double) * 100 / case when t = 0 then 1.0 else cast(t as double) end, 1), 100.0) as bar_percent from tot""",
)
def q_channels(spark, sf_dir):
    rows = lab.with_channel_and_merchant(entries(spark, sf_dir))
    return analytics.channel_summary(rows).select(
        "statement_id", "channel", amount("total_amount").alias("total_amount"), "count", "bar_percent"
    )


@query(
    "top_merchants",
    f"""with {merchant_steps('ledger', 'txn_id')},
   per as (select statement_id, merchant, sum(debit) as s, count(*) as n from ledger join merchants using (txn_id)
     where debit > 0 and merchant is not null and merchant <> '' group by 1, 2),
   ranked as (select *, row_number() over (partition by statement_id order by s desc, merchant) as rank from per)
   select statement_id, merchant, cast(s as double) as total_amount, n as count, rank from ranked where rank <= 8""",
)
def q_merchants(spark, sf_dir):
    rows = lab.with_channel_and_merchant(entries(spark, sf_dir))
    return analytics.top_merchants(rows).select(
        "statement_id", "merchant", amount("total_amount").alias("total_amount"), "count",
        F.col("rank").cast("long").alias("rank"),
    )


@query(
    "top_merchants_book",
    f"""with {merchant_steps('ledger', 'txn_id')}
   select merchant, cast(sum(debit) as double) as total_amount, count(*) as count from ledger join merchants using (txn_id)
   where debit > 0 and merchant is not null and merchant <> '' group by 1 order by sum(debit) desc, merchant limit 8""",
)
def q_merchants_book(spark, sf_dir):
    rows = lab.with_channel_and_merchant(entries(spark, sf_dir))
    return (
        analytics.with_merchant(rows.where("debit > 0").select("merchant", "debit"))
        .groupBy("merchant")
        .agg(F.sum("debit").alias("total"), F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("total"), "merchant")
        .limit(analytics.TOP_MERCHANTS)
        .select("merchant", amount("total").alias("total_amount"), "count")
    )


@query(
    "monthly_trend",
    """select statement_id, strftime(txn_date, '%Y-%m') as month, cast(sum(debit) as double) as total_debit,
   cast(sum(credit) as double) as total_credit, cast(sum(credit) - sum(debit) as double) as net from ledger group by 1, 2""",
)
def q_monthly(spark, sf_dir):
    return analytics.monthly_trend(entries(spark, sf_dir)).select(
        "statement_id", "month", amount("total_debit").alias("total_debit"),
        amount("total_credit").alias("total_credit"), amount("net").alias("net"),
    )


@query(
    "balance_health",
    f"""with {AUDIT_STEPS} select statement_id, count(*) filter (balance_verified) as verified, count(*) as total,
   round(count(*) filter (balance_verified) * 100.0::double / count(*), 1) as percentage from audited group by 1""",
)
def q_health(spark, sf_dir):
    return analytics.health_of_totals(audit.audited_totals(ledger(spark, sf_dir)))


@query(
    "empty_statement",
    f"""with {AUDIT_STEPS}, agg as (select statement_id, sum(debit) as d, sum(credit) as c, count(*) as n,
     count(*) filter (balance_verified) as v from audited group by 1)
   select c_custkey as statement_id, coalesce(cast(d as double), 0.0) as total_debits, coalesce(cast(c as double), 0.0) as total_credits,
   coalesce(cast(c - d as double), 0.0) as net_cash_flow, coalesce(n, 0) as transaction_count, coalesce(v, 0) as verified,
   coalesce(n, 0) as total, coalesce(round(v * 100.0::double / n, 1), 100.0) as percentage
   from customer left join agg on statement_id = c_custkey""",
)
def q_empty(spark, sf_dir):
    statements = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("statement_id"))
    report = analytics.report_for_all(statements, audit.audit(ledger(spark, sf_dir)))
    return report.select(
        "statement_id", amount("total_debits").alias("total_debits"),
        amount("total_credits").alias("total_credits"), amount("net_cash_flow").alias("net_cash_flow"),
        "transaction_count", "verified", "total", "percentage",
    )


@query(
    "report_cube",
    f"""with {LABELLED}, x as (select case when debit > 0 then category end as category,
     strftime(txn_date, '%Y-%m') as month, debit, credit from labelled)
   select 'category' as level, category as item, cast(sum(debit) as double) as total_debit, cast(sum(credit) as double) as total_credit, count(*) as count
     from x where category is not null group by category
   union all select 'month', month, cast(sum(debit) as double), cast(sum(credit) as double), count(*) from x group by month
   union all select 'total', 'all', cast(sum(debit) as double), cast(sum(credit) as double), count(*) from x""",
)
def q_cube(spark, sf_dir):
    return analytics.report_cube(labelled_entries(spark, sf_dir)).select(
        "level", "item", amount("total_debit").alias("total_debit"),
        amount("total_credit").alias("total_credit"), "count",
    )


@query(
    "search",
    f"""with {LABELLED} select txn_id, description, category, cast(debit as double) as debit from labelled
   where (contains(lower(description), 'amazon') or contains(lower(coalesce(merchant, '')), 'amazon'))
     and category = 'Shopping & E-Commerce' and debit > 0""",
)
def q_search(spark, sf_dir):
    found = lab.search(labelled_entries(spark, sf_dir), "Amazon", "Shopping & E-Commerce", "Debit")
    return found.select("txn_id", "description", "category", amount("debit").alias("debit"))


# ---- audit ------------------------------------------------------------------------------

def audited_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(ledger(spark, sf_dir))


@query(
    "audit_direction",
    f"""with {AUDIT_STEPS} select statement_id, forward_matches, reverse_matches,
   reverse_matches > forward_matches as is_reverse from votes""",
)
def q_direction(spark, sf_dir):
    steps = audit.checked_steps(ledger(spark, sf_dir))
    return audit.direction(steps).select(
        "statement_id", "forward_matches", "reverse_matches", "is_reverse"
    )


@query(
    "audit_rows",
    f"with {AUDIT_STEPS} select statement_id, txn_id, cast(row_no as bigint) as row_no, balance_verified from audited",
)
def q_audit(spark, sf_dir):
    return audited_ledger(spark, sf_dir).select("statement_id", "txn_id", "row_no", "balance_verified")


@query(
    "audit_anomalies",
    f"""with {AUDIT_STEPS} select statement_id, cast(row_no as bigint) as row_no,
   'Row ' || row_no || ' (' || strftime(txn_date, '%Y-%m-%d') || '): ' ||
   case when is_reverse then 'Reverse ledger mismatch! Expected ' || cast(expected as decimal(18,2)) || ', Found ' || balance
   else 'Balance mismatch! Expected ' || cast(expected as decimal(18,2)) || ' (from prev ' || pb || ' - Dr ' || debit || ' + Cr ' || credit
     || '), Found ' || balance || ' (diff: ' || cast(abs(expected - balance) as decimal(18,2)) || ')' end as anomaly
   from audited where not balance_verified""",
)
def q_anomalies(spark, sf_dir):
    return audit.anomalies(audited_ledger(spark, sf_dir))


@query(
    "statement_totals",
    f"""with {AUDIT_STEPS} select statement_id, count(*) as total_transactions, cast(sum(debit) as double) as total_debits,
   cast(sum(credit) as double) as total_credits, cast(sum(credit) - sum(debit) as double) as net_cash_flow,
   count(*) filter (not balance_verified) as balance_mismatches_count from audited group by 1""",
)
def q_statement_totals(spark, sf_dir):
    return audit.audited_totals(ledger(spark, sf_dir)).select(
        "statement_id", "total_transactions", amount("total_debits").alias("total_debits"),
        amount("total_credits").alias("total_credits"), amount("net_cash_flow").alias("net_cash_flow"),
        "balance_mismatches_count",
    )


DERIVED = """derived as (select statement_id, arg_min(balance + debit - credit, row_no) as o, arg_max(balance, row_no) as c,
   max(balance) as hi, sum(debit) as d, sum(credit) as cr from ledger group by 1)"""


@query(
    "derived_balances",
    f"""with {DERIVED} select statement_id, cast(case when hi > 0 then o end as double) as opening_balance,
   cast(case when hi > 0 then c end as double) as closing_balance from derived""",
)
def q_derived(spark, sf_dir):
    return audit.derived_balances(ledger(spark, sf_dir)).select(
        "statement_id", amount("opening_balance").alias("opening_balance"),
        amount("closing_balance").alias("closing_balance"),
    )


@query(
    "audit_identity",
    f"""with {DERIVED}, both_ as (select statement_id, case when statement_id % 7 = 0 then cast(c_acctbal as decimal(18,2)) when hi > 0 then o end as opening,
     case when hi > 0 then c end as closing0, d, cr from derived join customer on c_custkey = statement_id),
   fin as (select *, coalesce(closing0, opening + cr - d) as closing from both_)
   select statement_id, cast(opening as double) as opening_balance, cast(closing as double) as closing_balance,
   cast(opening + cr - d - closing as double) as gap, abs(opening + cr - d - closing) < 0.05 as identity_holds from fin""",
)
def q_identity(spark, sf_dir):
    # every seventh statement states its opening balance, the others derive it
    stated = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").select(
        F.col("c_custkey").alias("statement_id"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("opening_balance"),
        F.lit(None).cast("decimal(18,2)").alias("closing_balance"),
    )
    balances = audit.with_stated_balances(audit.derived_balances(ledger(spark, sf_dir)), stated)
    return audit.identity(balances).select(
        "statement_id", amount("opening_balance").alias("opening_balance"),
        amount("closing_balance").alias("closing_balance"), amount("gap").alias("gap"), "identity_holds",
    )


# ---- report layouts ---------------------------------------------------------------------

def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audited and labelled ledger with every column the reports use."""
    return lab.label_by_rules(audited_ledger(spark, sf_dir)).withColumn(
        "chq_ref_no", F.lit(None).cast("string")
    )


REPORTED = f"{AUDIT_STEPS}, {labelled_steps('audited')}"


@query(
    "csv_projection",
    f"""with {REPORTED} select strftime(txn_date, '%Y-%m-%d') as "Date", description as "Description",
   coalesce(merchant, '') as "Merchant", channel as "Channel", cast(debit as double) as "Debit",
   cast(credit as double) as "Credit", cast(balance as double) as "Balance", category as "Category",
   coalesce(sub_category, '') as "SubCategory", confidence as "Confidence",
   '{K.METHOD_HEURISTIC_MODE}' as "ClassificationMethod", balance_verified as "BalanceVerified", '' as "RefNo" from labelled""",
)
def q_csv(spark, sf_dir):
    rows = reports.csv_rows(full_ledger(spark, sf_dir))
    for c in ("Debit", "Credit", "Balance"):
        rows = rows.withColumn(c, amount(c))
    return rows.drop("statement_id", "row_no")


@query(
    "sheet_transactions",
    f"""with {REPORTED} select statement_id, cast(row_no as bigint) as row_no, strftime(txn_date, '%Y-%m-%d') as "Date",
   description as "Description", coalesce(merchant, '-') as "Merchant / Entity", channel as "Channel",
   case when debit > 0 then cast(debit as varchar) else '' end as "Debit (Dr)",
   case when credit > 0 then cast(credit as varchar) else '' end as "Credit (Cr)", cast(balance as double) as "Balance",
   category as "Assigned Category", coalesce(sub_category, '-') as "Sub-Category",
   cast(floor(confidence * 100) as int) || '%' as "Confidence", '{K.METHOD_HEURISTIC_MODE}' as "Classification Method",
   case when balance_verified then 'Verified' else 'Mismatch' end as "Audit Verified" from labelled""",
)
def q_sheet_transactions(spark, sf_dir):
    return reports.sheet_transactions(full_ledger(spark, sf_dir)).withColumn("Balance", amount("Balance"))


@query(
    "sheet_category",
    f"""with {LABELLED}, per as (select statement_id, category, sum(debit) as s, count(*) as n from labelled
   where debit > 0 group by 1, 2)
   select statement_id, category as "Category", cast(s as double) as "Total Spent (Debit)", n as "Txn Count",
   cast(round(cast(s as double) * 100 / cast(sum(s) over (partition by statement_id) as double), 1) as varchar) || '%' as "% of Expenses" from per""",
)
def q_sheet_category(spark, sf_dir):
    sheet = reports.sheet_category(analytics.category_summary(labelled_entries(spark, sf_dir)))
    return sheet.withColumn("Total Spent (Debit)", amount("Total Spent (Debit)"))


@query(
    "sheet_monthly",
    """select statement_id, strftime(txn_date, '%Y-%m') as "Month", cast(sum(debit) as double) as "Total Debits (Expenses)",
   cast(sum(credit) as double) as "Total Credits (Income)", cast(sum(credit) - sum(debit) as double) as "Net Savings / Flow" from ledger group by 1, 2""",
)
def q_sheet_monthly(spark, sf_dir):
    sheet = reports.sheet_monthly(analytics.monthly_trend(entries(spark, sf_dir)))
    for c in sheet.columns[2:]:
        sheet = sheet.withColumn(c, amount(c))
    return sheet
