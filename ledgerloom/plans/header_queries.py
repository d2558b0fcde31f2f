"""Queries that read statement metadata back from rendered first pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import metadata
from .label_sql import quoted
from .registry import amount, query
from .rendered_headers import PEOPLE_SQL, header_pages, people

DEFAULT_YEAR = 2024
CLEARING_SQL = "clearing(prefix, issuer) as (values " + ", ".join(
    f"({quoted(p)}, {quoted(n)})" for p, n in K.CLEARING_PREFIXES.items()
) + ")"


def details(spark, sf_dir):
    return metadata.account_details(header_pages(spark, sf_dir), default_year=DEFAULT_YEAR)


def head(select: str) -> str:
    return f"with {PEOPLE_SQL} {select}"


@query(
    "account_no",
    head("""select statement_id, case v when 0 then '50100' || six || '77' when 1 then 'XXXXXX' || six
     when 2 then 'GB82WEST' || six || '98765432' when 3 then six || '-5555' when 4 then six || '00112233' else 'Not Found' end as account_number from people"""),
    ledger=False,
)
def q_account(spark, sf_dir):
    return details(spark, sf_dir).select("statement_id", "account_number")


@query(
    "bank_code",
    head("""select statement_id, case v when 0 then prefix || '0' || six when 1 then 'ABCDEFGH' when 2 then prefix || '0' || six
     when 4 then 'QWERTYUIXXX' when 5 then prefix || '0' || six end as ifsc_code from people"""),
    ledger=False,
)
def q_code(spark, sf_dir):
    return details(spark, sf_dir).select("statement_id", "ifsc_code")


@query(
    "holder",
    head("select statement_id, case when v = 4 then 'Not Found' else person end as account_holder from people"),
    ledger=False,
)
def q_holder(spark, sf_dir):
    return details(spark, sf_dir).select("statement_id", "account_holder")


@query(
    "branch",
    head("""select statement_id, case v when 0 then town || ' High Road' when 2 then town || ', Block 7' when 4 then town end as branch from people"""),
    ledger=False,
)
def q_branch(spark, sf_dir):
    return details(spark, sf_dir).select("statement_id", "branch")


@query(
    "period",
    head("""select statement_id, case v when 0 then year || '-08-01' when 1 then year || '-02-05' when 2 then year || '-01-03' when 3 then year || '-09-01' when 4 then year || '-05-01' end as statement_period_start,
     case v when 0 then year || '-08-31' when 1 then year || '-03-04' when 2 then year || '-03-02' when 3 then year || '-09-30' when 4 then year || '-05-31' end as statement_period_end from people"""),
    ledger=False,
)
def q_period(spark, sf_dir):
    return details(spark, sf_dir).select("statement_id", "statement_period_start", "statement_period_end")


# After "on <date>" the date wording takes every digit it can, so the last one before the
# decimal point is all that is left of the whole units.
@query(
    "stated_balances",
    head("""select statement_id, cast(case when v in (0, 1) then abs(bal) when v = 2 then abs(bal) % 10 end as double) as opening_balance,
     cast(case when v in (0, 3) then abs(bal) when v = 2 then abs(bal) % 10 end as double) as closing_balance from people"""),
    ledger=False,
)
def q_stated(spark, sf_dir):
    return details(spark, sf_dir).select(
        "statement_id", amount("opening_balance").alias("opening_balance"),
        amount("closing_balance").alias("closing_balance"),
    )


@query(
    "statement_year",
    head("select statement_id, cast(year as integer) as statement_year from people"),
    ledger=False,
)
def q_year(spark, sf_dir):
    return metadata.statement_years(header_pages(spark, sf_dir)).select(
        "statement_id", F.col("statement_year").cast("int").alias("statement_year")
    )


@query(
    "detect_issuer",
    f"""with {PEOPLE_SQL}, {CLEARING_SQL}
   select statement_id, case v when 0 then town || ' Bank' when 1 then 'Bank of ' || town when 2 then coalesce(issuer, prefix || ' Bank')
     when 3 then upper(town[1]) || lower(town[2:]) || 'bank' when 4 then town || ' Trust' else upper(town) || ' Bank' end as bank_name,
   cast(case v when 0 then 0.92 when 1 then 0.92 when 2 then case when issuer is null then 0.85 else 0.95 end when 3 then 0.88 when 4 then 0.95 else 0.90 end as double) as bank_confidence
   from people left join clearing using (prefix)""",
    ledger=False,
)
def q_issuer(spark, sf_dir):
    return metadata.detect_issuers(header_pages(spark, sf_dir))


@query(
    "redetect_issuer",
    f"""with {PEOPLE_SQL}, {CLEARING_SQL}
   select statement_id, case v when 2 then coalesce(issuer, prefix || ' Bank') else town || ' Bank' end as bank_name from people left join clearing using (prefix)""",
    ledger=False,
)
def q_redetect(spark, sf_dir):
    # the first text of most accounts names no issuer, the rebuilt one does
    who = people(spark, sf_dir)
    generic = who.select(
        "statement_id",
        F.when(F.col("v") == 2, F.concat(F.lit("IFSC "), F.col("prefix"), F.lit("0"), F.col("six")))
        .otherwise(F.lit("plain page")).alias("text"),
    )
    rebuilt = who.select("statement_id", F.concat("town", F.lit(" Bank plc")).alias("text"))
    one = F.lit(1).cast("long").alias("page_no")
    first = metadata.detect_issuers(generic.select("statement_id", one, "text"))
    second = metadata.detect_issuers(rebuilt.select("statement_id", one, "text"))
    return metadata.redetect(first, second).select("statement_id", "bank_name")


@query(
    "issuer_lookup",
    f"""with {PEOPLE_SQL}, {CLEARING_SQL}
   select statement_id, coalesce(issuer, prefix || ' Bank') as issuer, cast(case when issuer is null then 0.85 else 0.95 end as double) as issuer_confidence
   from people left join clearing using (prefix)""",
    ledger=False,
)
def q_lookup(spark, sf_dir):
    codes = people(spark, sf_dir).select("statement_id", F.concat("prefix", F.lit("0"), F.col("six")).alias("code"))
    return metadata.issuer_lookup(codes, "code").select("statement_id", "issuer", "issuer_confidence")
