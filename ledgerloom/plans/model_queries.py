"""Queries of the text classifier: corpus, weights, training, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import corpus, model
from ..operators import labelling as lab
from ..session import shared_folder, stage
from .book_queries import LABELLED, NORMALIZED_SQL, entries, labelled_entries, stub_scores, _NAMES13
from .registry import query

WORDS_SQL = f"""norm as (select txn_id, category, regexp_extract_all({NORMALIZED_SQL.format(c='description')}, '\\w\\w+') as w from labelled),
 grams as (select txn_id, category, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from norm),
 counts as (select txn_id, category, term, count(*) as tf from grams group by 1, 2, 3),
 known as (select term, sum(tf) as total, count(*) as docs from counts group by 1 order by total desc, term limit 5000),
 size_ as (select count(*) as n from norm),
 raw as (select txn_id, category, term, (1 + ln(tf)) * (ln((1 + n) / (1 + docs)) + 1) as r from counts join known using (term), size_),
 norms as (select txn_id, sqrt(sum(r * r)) as norm from raw group by 1),
 weights as (select txn_id, category, term, r / norm as weight from raw join norms using (txn_id))"""


def labelled_texts(spark, sf_dir):
    """Narrations with the category the rules give them: a corpus that grows with the ledger."""
    return labelled_entries(spark, sf_dir).select("txn_id", "category", "description")


@query("tfidf", f"with {LABELLED}, {WORDS_SQL} select txn_id, term, round(weight, 6) as weight from weights")
def q_tfidf(spark, sf_dir):
    out = model.tfidf(entries(spark, sf_dir).select("txn_id", "description"), "txn_id")
    return out.select("txn_id", "term", F.round("weight", 6).alias("weight"))


@query(
    "naive_bayes",
    f"""with {LABELLED}, {WORDS_SQL}, sums as (select category, term, sum(weight) as s from weights group by 1, 2),
   prior as (select category, count(*) as n from norm group by 1), words as (select distinct term from sums),
   per as (select category, sum(s) as cs from sums group by 1), grid as (select category, n, term from prior, words)
   select category, term, round(ln((coalesce(s, 0) + 0.1) / (cs + 0.1 * (select count(*) from words))), 5) as log_prob,
   round(ln(n / (select sum(n) from prior)), 5) as log_prior from grid left join sums using (category, term) join per using (category)""",
)
def q_naive_bayes(spark, sf_dir):
    texts = labelled_texts(spark, sf_dir)
    weights = model.tfidf(texts.select("txn_id", "description"), "txn_id")
    out = model.naive_bayes_table(weights, texts.select("txn_id", "category"), "txn_id")
    return out.select(
        "category", "term", F.round("log_prob", 5).alias("log_prob"), F.round("log_prior", 5).alias("log_prior")
    )


@query(
    "stratified_split",
    f"""with {LABELLED}, r as (select txn_id, category, row_number() over (partition by category order by md5('42|' || txn_id), txn_id) as k,
     count(*) over (partition by category) as n from labelled)
   select txn_id, category, k <= floor(n * 0.2 + 0.5) as is_test from r""",
)
def q_split(spark, sf_dir):
    rows = labelled_texts(spark, sf_dir).select("txn_id", "category")
    return corpus.stratified_split(rows, "category", "txn_id").select("txn_id", "category", "is_test")


@query(
    "class_report",
    f"""with {LABELLED}, p as (select category as label, ({_NAMES13})[txn_id % 13 + 1] as pred from labelled),
   names as (select label as c from p union select pred from p),
   agg as (select c, count(*) filter (label = c) as support, count(*) filter (pred = c) as claimed, count(*) filter (label = c and pred = c) as hits from names, p group by 1),
   pr as (select c, support, case when claimed > 0 then hits / claimed else 0.0 end as precision_, case when support > 0 then hits / support else 0.0 end as recall_ from agg)
   select c as class, round(precision_, 6) as precision, round(recall_, 6) as recall,
   round(case when precision_ + recall_ > 0 then 2 * precision_ * recall_ / (precision_ + recall_) else 0.0 end, 6) as f1, support,
   round((select count(*) filter (label = pred) / count(*) from p), 6) as accuracy from pr""",
)
def q_report(spark, sf_dir):
    report = model.class_report(stub_scores(labelled_texts(spark, sf_dir)))
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 6).alias("accuracy"))


def _hex(salt: str, digits: int) -> str:
    return f"cast('0x' || substr(md5('{salt}|' || description || '|' || variant), 1, {digits}) as bigint)"


@query(
    "augment_corpus",
    f"""with x as (select txn_id, description, unnest(range(0, 6)) as variant from ledger),
   y as (select txn_id, variant, description as d, lpad(cast({_hex('ref', 12)} % 1000000000000 as varchar), 12, '0') as ref,
     (['HARBOUR', 'MERIDIAN', 'CEDAR', 'LAGOON', 'SUMMIT'])[{_hex('bank', 8)} % 5 + 1] as bank,
     cast({_hex('branch', 8)} % 900 + 100 as varchar) as branch, {_hex('kind', 8)} % 4 as kind from x)
   select txn_id, cast(variant as integer) as variant, case when variant = 0 then d when kind = 0 then bank || ' ONLINE ' || d || ' NO ' || ref
     when kind = 1 then 'TRF ' || ref || ' BR ' || branch || ' ' || d
     when kind = 2 then 'CARD XX' || ref[1:4] || ' ' || d || ' AT ' || bank else 'ENTRY ' || ref[1:9] || ': ' || d end as description from y""",
)
def q_augment(spark, sf_dir):
    seeds = entries(spark, sf_dir).select("txn_id", "description")
    return corpus.augment(seeds, multiplier=5).select("txn_id", "variant", "description")


def _trained(spark, sf_dir, kind="logistic_regression"):
    return model.train(labelled_texts(spark, sf_dir), key="txn_id", kind=kind)


@query("logreg")
def q_logreg(spark, sf_dir):
    _, report = _trained(spark, sf_dir)
    return report


SPLIT_SQL = """dealt as (select txn_id, category, row_number() over (partition by category order by md5('42|' || txn_id), txn_id) as k,
   count(*) over (partition by category) as n from labelled),
 training as (select l.txn_id, l.category, l.description from labelled l join dealt d using (txn_id) where k > floor(n * 0.2 + 0.5))"""

# Slopes of the mean loss; those of coefficients that are all zero reach some hundredths.
FLAT = 1e-5


@query(
    "logreg_certificate",
    f"""with {LABELLED}, {SPLIT_SQL}, {WORDS_SQL.replace('from labelled', 'from training')}
   select category, term, true as optimal from (select distinct category from training), (select term from known union all select '{model.INTERCEPT}')""",
)
def q_certificate(spark, sf_dir):
    """Whether the loss is flat at each coefficient: the fit is then the best there is."""
    rows = corpus.stratified_split(labelled_texts(spark, sf_dir), "category", "txn_id").where("NOT is_test")
    rows = stage(rows.select("txn_id", "category", "description"), "training")
    slopes = model.gradient(model.fit(rows), rows, "txn_id")
    return slopes.select("category", "term", (F.abs("gradient") <= FLAT).alias("optimal"))


@query(
    "model_facts",
    f"""with {LABELLED}, {SPLIT_SQL}, c as (select distinct category from training)
   select cast(row_number() over (order by category) - 1 as integer) as position, category, (select count(*) from labelled) as total_samples,
   (select count(*) from training) as train_samples, (select count(*) from labelled) - (select count(*) from training) as test_samples from c""",
)
def q_facts(spark, sf_dir):
    return q_info(spark, sf_dir).drop("accuracy")


# Naive Bayes fitted on the training rows, and its margins over all narrations. Class priors are
# smoothed like terms.
_BAYES_SQL = f"""{SPLIT_SQL}, {WORDS_SQL.replace('from labelled', 'from training')},
   sums as (select category, term, sum(weight) as s from weights group by 1, 2), per as (select category, sum(s) as cs from sums group by 1),
   prior as (select category, ln(count(*) + {model.NB_SMOOTHING}) - ln((select count(*) from training) + {model.NB_SMOOTHING} * (select count(distinct category) from training)) as p
     from training group by 1),
   theta as (select category, term, ln(coalesce(s, 0) + {model.NB_SMOOTHING}) - ln(cs + {model.NB_SMOOTHING} * (select count(*) from known)) as t
     from prior cross join known join per using (category) left join sums using (category, term)),
   n2 as (select txn_id, regexp_extract_all({NORMALIZED_SQL.format(c='description')}, '\\w\\w+') as w from labelled),
   g2 as (select txn_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from n2),
   c2 as (select txn_id, term, count(*) as tf from g2 group by 1, 2),
   r2 as (select txn_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + docs)) + 1) as r from c2 join known using (term), size_),
   w2 as (select txn_id, term, r / sqrt(sum(r * r) over (partition by txn_id)) as weight from r2),
   m2 as (select txn_id, category, sum(weight * t) as m from w2 join theta using (term) group by 1, 2),
   margins as (select l.txn_id, p.category, p.p + coalesce(m, 0) as m from labelled l cross join prior p left join m2 on m2.txn_id = l.txn_id and m2.category = p.category),
   tops as (select txn_id, max(m) as top from margins group by 1),
   predicted as (select txn_id, arg_min(category, category) filter (m = top) as ml_category, round(1 / sum(exp(m - top)), 3) as ml_confidence
     from margins join tops using (txn_id) group by 1)"""


@query(
    "naive_bayes_model",
    f"""with {LABELLED}, {_BAYES_SQL}, p as (select l.category as label, ml_category as pred from labelled l join dealt d using (txn_id) join predicted using (txn_id)
     where k <= floor(n * 0.2 + 0.5)),
   names as (select label as c from p union select pred from p),
   agg as (select c, count(*) filter (label = c) as support, count(*) filter (pred = c) as claimed, count(*) filter (label = c and pred = c) as hits from names, p group by 1),
   pr as (select c, support, case when claimed > 0 then hits / claimed else 0.0 end as precision_, case when support > 0 then hits / support else 0.0 end as recall_ from agg)
   select c as class, round(precision_, 6) as precision, round(recall_, 6) as recall,
   round(case when precision_ + recall_ > 0 then 2 * precision_ * recall_ / (precision_ + recall_) else 0.0 end, 6) as f1, support,
   round((select count(*) filter (label = pred) / count(*) from p), 6) as accuracy from pr""",
)
def q_nb_model(spark, sf_dir):
    _, report = _trained(spark, sf_dir, "naive_bayes")
    return report.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", F.round("accuracy", 6).alias("accuracy"))


@query("predict_naive_bayes", f"with {LABELLED}, {_BAYES_SQL} select txn_id, ml_category, ml_confidence from predicted")
def q_predict_bayes(spark, sf_dir):
    """Every narration labelled by a model that SQL can repeat: same terms, scaling and margins as ``predict``."""
    fitted, _ = _trained(spark, sf_dir, "naive_bayes")
    return fitted.score(entries(spark, sf_dir)).select("txn_id", "ml_category", "ml_confidence")


@query("predict")
def q_predict(spark, sf_dir):
    fitted, _ = _trained(spark, sf_dir)
    return fitted.score(entries(spark, sf_dir)).select("txn_id", "ml_category", "ml_confidence")


@query("classify_hybrid_model")
def q_hybrid_model(spark, sf_dir):
    # the model of the seed corpus labels every narration of the ledger, rules permitting
    fitted, _ = model.train(spark=spark)
    labelled = lab.classify(entries(spark, sf_dir), lab.HYBRID, fitted)
    return labelled.select("txn_id", "category", "confidence", "classification_method")


@query("model_info")
def q_info(spark, sf_dir):
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fitted, _ = _trained(spark, sf_dir)
    fitted.save(path)
    return model.model_info(spark, path)
