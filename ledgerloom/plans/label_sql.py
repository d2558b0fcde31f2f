"""SQL wording of the labelling rules, used to compare results with another engine."""

from __future__ import annotations

from ..functions import constants as K


# RE2 word borders are ASCII only; these are the Unicode ones.
EDGE_BEFORE, EDGE_AFTER = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"


def whole_word(words: str) -> str:
    return quoted(f"{EDGE_BEFORE}({words}){EDGE_AFTER}")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {quoted(w)})" for w in words) + ")"


def token_case(d: str, is_credit: str) -> str:
    arms = []
    for category, words in K.TOKENS.items():
        guard = ""
        if category in K.TOKENS_CREDIT_ONLY:
            guard = f"{is_credit} and "
        elif category in K.TOKENS_NOT_CREDIT:
            guard = f"not {is_credit} and "
        arms.append(f"when {guard}{any_of(d, words)} then {quoted(category)}")
    return "case " + "\n ".join(arms) + " end"


def word_case(d: str, is_debit: str, is_credit: str) -> str:
    guard = {"DEBIT": f"{is_debit} and ", "CREDIT": f"{is_credit} and ", "ANY": ""}
    arms = [
        f"when {guard[need]}regexp_matches({d}, {whole_word('|'.join(words))})"
        f" then {quoted(category)}"
        for category, need, words in K.WORD_RULES
    ]
    return "case " + "\n ".join(arms) + " end"


def channel_case(d: str) -> str:
    arms = [
        f"when regexp_matches({d}, {whole_word(words)}, 'i') then {quoted(name)}"
        for words, name in K.CHANNELS
    ]
    return "case " + "\n ".join(arms) + f" else {quoted(K.DEFAULT_CHANNEL)} end"


def merchant_steps(source: str, key: str) -> str:
    """CTE ``merchants(key, merchant)``; title case, null when none."""
    brands = quoted(r"\b(" + "|".join(K.MERCHANT_BRANDS) + r")\b")
    clean = "trim(regexp_replace(trim(regexp_extract(description, {p}, 1, 'i')), '[/\\\\_-]', ' ', 'g'))"
    parts = [clean.format(p=p) for p in (brands, quoted(K.MERCHANT_UPI), quoted(K.MERCHANT_PAYEE))]
    return f"""found as (select {key}, {parts[0]} as a, {parts[1]} as b, {parts[2]} as c from {source}),
picked as (select {key}, case when length(a) > 2 and not regexp_full_match(a, '[0-9]+') then a
   when length(b) > 2 and not regexp_full_match(b, '[0-9]+') then b
   when length(c) > 2 and not regexp_full_match(c, '[0-9]+') then c end as m from found),
merchants as (select {key}, array_to_string(list_transform(regexp_extract_all(lower(m), '[a-z]+|[^a-z]+'),
   lambda x: upper(x[1]) || x[2:]), '') as merchant from picked)"""


def labelled_steps(source: str = "ledger") -> str:
    """CTE ``labelled``: the source with channel, merchant and rule labels (key: txn_id)."""
    credit, debit = "(credit > 0 or type = 'CREDIT')", "(debit > 0 or type = 'DEBIT')"
    return f"""{merchant_steps(source, 'txn_id')},
hits as (select l.*, lower(description) as d, {channel_case('description')} as channel, merchant
   from {source} l join merchants using (txn_id)),
ruled as (select *, coalesce({token_case('d', credit)}, {word_case('d', debit, credit)}) as hit from hits),
labelled as (select *,
   case when hit is not null then hit
        when {any_of('d', K.TRANSFER_WORDS)} then {quoted(K.TRANSFER)}
        when {credit} then {quoted(K.SALARY)} else {quoted(K.MISC)} end as category,
   case when hit is null and not {any_of('d', K.TRANSFER_WORDS)} and {credit} then 'Other Deposit' end as sub_category,
   cast(case when hit is not null then {K.RULE_CONFIDENCE}
        when {any_of('d', K.TRANSFER_WORDS)} then {K.TRANSFER_CONFIDENCE}
        when {credit} then {K.OTHER_DEPOSIT_CONFIDENCE} else {K.MISC_CONFIDENCE} end as double) as confidence
   from ruled)"""


AUDIT_STEPS = """lagged as (select *, lag(balance) over w as pb, lag(debit) over w as pd, lag(credit) over w as pc
   from ledger window w as (partition by statement_id order by row_no)),
steps as (select *, pb - debit + credit as fwd, pb + pd - pc as rev from lagged),
votes as (select statement_id, count(*) filter (abs(fwd - balance) < 0.05) as forward_matches,
   count(*) filter (abs(rev - balance) < 0.05) as reverse_matches from steps group by 1),
audited as (select s.*, reverse_matches > forward_matches as is_reverse,
   case when reverse_matches > forward_matches then rev else fwd end as expected,
   row_no = 1 or coalesce(abs(case when reverse_matches > forward_matches then rev else fwd end - balance) < 0.05, false)
     as balance_verified
   from steps s join votes using (statement_id))"""
