"""Labelling a ledger: channel, merchant, category by rules, by model or by both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.labels import channel, merchant, rule_labels

HEURISTIC = "Heuristic Rule-Based"
ML = "Traditional Machine Learning (TF-IDF)"
HYBRID = "Hybrid Ensemble"


def with_channel_and_merchant(ledger: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("description"), F.lit(""))
    return ledger.withColumn("channel", channel(text)).withColumn("merchant", merchant(text))


def label_by_rules(ledger: DataFrame) -> DataFrame:
    """Channel, merchant and rule labels: one projection over the ledger, no shuffle."""
    return rule_labels(with_channel_and_merchant(ledger)).withColumn(
        "classification_method", F.lit(K.METHOD_HEURISTIC_MODE)
    )


def combine(scored: DataFrame, mode: str = HYBRID) -> DataFrame:
    """Final label from ``rule_*`` and ``ml_category`` / ``ml_confidence`` columns.

    In the hybrid mode a trusted rule wins, then a trusted model, then the larger confidence
    (the rule on a tie). Any unknown mode is the hybrid mode. A model label keeps an existing
    ``sub_category`` column as it is.
    """
    kept = F.col("sub_category") if "sub_category" in scored.columns else F.lit(None).cast("string")
    rule_conf, ml_conf = F.col("rule_confidence"), F.col("ml_confidence")
    if mode == HEURISTIC:
        use_rule = F.lit(True)
        names = (K.METHOD_HEURISTIC_MODE, K.METHOD_HEURISTIC_MODE)
    elif mode == ML:
        use_rule = F.lit(False)
        names = (K.METHOD_ML_MODE, K.METHOD_ML_MODE)
    else:
        use_rule = (rule_conf >= K.HEURISTIC_TRUST) | (
            ~(ml_conf >= K.MODEL_TRUST) & (rule_conf >= ml_conf)
        )
        names = (K.METHOD_HYBRID_RULES, K.METHOD_HYBRID_MODEL)
    chosen = scored.withColumn("_rule", use_rule)
    by_rule = F.col("_rule")
    return (
        chosen.withColumn("category", F.when(by_rule, F.col("rule_category")).otherwise(F.col("ml_category")))
        .withColumn("sub_category", F.when(by_rule, F.col("rule_sub_category")).otherwise(kept))
        .withColumn("confidence", F.when(by_rule, rule_conf).otherwise(ml_conf))
        .withColumn("classification_method", F.when(by_rule, F.lit(names[0])).otherwise(F.lit(names[1])))
        .drop("_rule", "rule_category", "rule_sub_category", "rule_confidence", "ml_category", "ml_confidence")
    )


def classify(ledger: DataFrame, mode: str = HYBRID, model=None) -> DataFrame:
    """Label (or re-label) a ledger under a mode; ``model`` is needed unless rules only."""
    base = with_channel_and_merchant(ledger)
    if mode == HEURISTIC:
        return rule_labels(base).withColumn("classification_method", F.lit(K.METHOD_HEURISTIC_MODE))
    if model is None:
        raise ValueError(f"mode {mode!r} needs a trained model")
    return combine(rule_labels(model.score(base), "rule_"), mode)


def apply_overrides(labelled: DataFrame, overrides: DataFrame, key: str = "txn_id") -> DataFrame:
    """Manual categories by transaction: they set category, method and full confidence."""
    manual = overrides.select(key, F.col("category").alias("_manual"))
    hit = F.col("_manual").isNotNull()
    return (
        labelled.join(manual, key, "left")
        .withColumn("category", F.coalesce("_manual", "category"))
        .withColumn("confidence", F.when(hit, F.lit(1.0)).otherwise(F.col("confidence")))
        .withColumn(
            "classification_method",
            F.when(hit, F.lit(K.METHOD_OVERRIDE)).otherwise(F.col("classification_method")),
        )
        .drop("_manual")
    )


def search(labelled: DataFrame, text: str = "", category: str = "All", kind: str = "All") -> DataFrame:
    """Rows whose narration or merchant holds the text, of one category and direction."""
    out = labelled
    # cheapest test first; amounts are tested in the scan
    if kind in ("Debit", "Credit"):
        out = out.where(F.col(kind.lower()) > 0)
    if text:
        needle = text.lower()
        out = out.where(
            F.lower("description").contains(needle) | F.coalesce(F.lower("merchant").contains(needle), F.lit(False))
        )
    if category != "All":
        out = out.where(F.col("category") == category)
    return out
