"""Channel, merchant and rule-based category of a narration, as column expressions.

Word borders use ``(?U)``: an accented letter is part of a word on every Java version.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import find, first_letters, has_any, literals, strip, title_case


def channel(description: Column) -> Column:
    """Payment channel: the first channel whose words occur in the narration."""
    chain = None
    for words, name in K.CHANNELS:
        hit = description.rlike(rf"(?iU)\b(?:{words})\b")
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(K.DEFAULT_CHANNEL))


def merchant(description: Column) -> Column:
    """Merchant or payee name in title case; null when none is recognised.

    A match of two characters or less, or of digits only, gives way to the next pattern.
    """
    patterns = [
        rf"(?iU){first_letters(K.MERCHANT_BRANDS)}\b({'|'.join(K.MERCHANT_BRANDS)})\b",
        f"(?i){K.MERCHANT_UPI}",
        f"(?i){K.MERCHANT_PAYEE}",
    ]

    def candidate(pattern: str) -> Column:
        name = strip(F.regexp_replace(strip(find(description, pattern, 1)), r"[/\\_\-]", " "))
        return F.when((F.length(name) > 2) & ~name.rlike(r"^\d+$"), name)

    return title_case(F.coalesce(*[candidate(p) for p in patterns]))


def money_directions(debit: Column, credit: Column, kind: Column) -> tuple[Column, Column]:
    """(is_debit, is_credit): amount *or* type, so both may hold for one row."""
    return (
        F.coalesce((debit > 0) | (kind == "DEBIT"), F.lit(False)),
        F.coalesce((credit > 0) | (kind == "CREDIT"), F.lit(False)),
    )


def token_category(narration: Column, is_credit: Column) -> Column:
    """First category one of whose literal tokens occurs in the lower-cased narration."""
    chain = None
    for category, tokens in K.TOKENS.items():
        hit = has_any(narration, tokens)
        if category in K.TOKENS_CREDIT_ONLY:
            hit = is_credit & hit
        elif category in K.TOKENS_NOT_CREDIT:
            hit = ~is_credit & hit
        value = F.lit(category)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def word_category(narration: Column, is_debit: Column, is_credit: Column) -> Column:
    """First category one of whose word patterns matches, given the money direction."""
    allowed = {"DEBIT": is_debit, "CREDIT": is_credit, "ANY": F.lit(True)}
    chain = None
    for category, direction, words in K.WORD_RULES:
        hit = allowed[direction] & narration.rlike(rf"(?U){first_letters(words)}\b(?:{'|'.join(words)})\b")
        value = F.lit(category)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def rule_labels(df, prefix: str = ""):
    """Add ``category``, ``sub_category`` and ``confidence`` of the rules (with a prefix).

    Needs ``description``, ``debit``, ``credit`` and ``type``. One projection, no shuffle.
    """
    narration = F.lower(F.coalesce(F.col("description"), F.lit("")))
    is_debit, is_credit = money_directions(F.col("debit"), F.col("credit"), F.col("type"))
    hit = F.coalesce(
        token_category(narration, is_credit), word_category(narration, is_debit, is_credit)
    )
    transfer = has_any(narration, K.TRANSFER_WORDS)
    fallback = F.when(transfer, F.lit(K.TRANSFER)).when(is_credit, F.lit(K.SALARY)).otherwise(F.lit(K.MISC))
    # The rule hit is one intermediate column and each result uses it once, so its chain is
    # evaluated once, also where a filter on the category is pushed below the projection.
    ruled = F.col("_hit").isNotNull()
    return (
        df.withColumn("_hit", hit)
        .withColumns(
            {
                f"{prefix}category": F.coalesce("_hit", fallback),
                f"{prefix}sub_category": F.when(~ruled & ~transfer & is_credit, F.lit("Other Deposit")),
                f"{prefix}confidence": F.when(ruled, F.lit(K.RULE_CONFIDENCE))
                .when(transfer, F.lit(K.TRANSFER_CONFIDENCE))
                .when(is_credit, F.lit(K.OTHER_DEPOSIT_CONFIDENCE))
                .otherwise(F.lit(K.MISC_CONFIDENCE)),
            }
        )
        .drop("_hit")
    )
