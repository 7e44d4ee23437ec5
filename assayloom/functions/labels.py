"""Rule-based labelling of free text and values as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrase lists that decide a label. They must equal the published curation rules.
GENERAL_NEGATIVE = (
    "inactive", "non-toxic", "nontoxic", "negative", "not active",
    "no activity", "no effect", "safe", "non-hepatotoxic", "weak",
    "not determined to be", "no significant",
)
GENERAL_POSITIVE = (
    "active", "toxic", "positive", "hepatotoxic", "nephrotoxic",
    "cytotoxic", "genotoxic", "cardiotoxic", "dili", "liver injury",
    "inhibitor", "inhibition", "potent", "strong",
)
ENDPOINT_PHRASES = {
    "ames": {
        "positive": ("positive", "mutagenic", "active", "genotoxic"),
        "negative": ("negative", "non-mutagenic", "inactive", "not mutagenic"),
    },
    "skin_sens": {
        "positive": ("sensitizer", "positive", "active", "allergenic"),
        "negative": ("non-sensitizer", "negative", "inactive", "not sensitizing"),
    },
    "cytotox": {
        "positive": ("cytotoxic", "toxic", "active", "cell death"),
        "negative": ("non-cytotoxic", "non-toxic", "inactive", "no effect"),
    },
    "reproductive_tox": {
        "positive": (
            "teratogenic", "embryotoxic", "fetotoxic", "reproductive toxicant",
            "developmental toxicity", "positive", "active", "toxic",
            "malformation", "birth defect", "fertility impaired",
        ),
        "negative": (
            "non-teratogenic", "not teratogenic", "negative", "inactive",
            "no effect", "safe", "no developmental", "no reproductive",
        ),
    },
}
# Units accepted by the value rule, and its cut in those units.
MICROMOLAR_UNITS = ("um", "µm", "micromolar")
CYTOTOX_CUT = 10.0
# Label text per endpoint (positive, negative).
LABEL_TEXT = {
    "herg": ("Cardiotoxic", "Non-cardiotoxic"),
    "hepatotox": ("Hepatotoxic", "Non-hepatotoxic"),
    "nephrotox": ("Nephrotoxic", "Non-nephrotoxic"),
    "ames": ("Mutagenic", "Non-mutagenic"),
    "skin_sens": ("Sensitizer", "Non-sensitizer"),
    "cytotox": ("Cytotoxic", "Non-cytotoxic"),
    "reproductive_tox": ("Reproductive toxicant", "Non-reproductive toxicant"),
}
DEFAULT_LABEL_TEXT = ("Positive", "Negative")


def mentions_any(text: Column, phrases: Sequence[str]) -> Column:
    """True when the text contains one of the phrases (plain substring, no pattern syntax)."""
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | F.contains(text, F.lit(phrase))
    return hit


def label_by_rules(
    text: Column,
    positive: Sequence[str] = GENERAL_POSITIVE,
    negative: Sequence[str] = GENERAL_NEGATIVE,
    order: str = "negative_first",
) -> Column:
    """1, 0 or null from phrase lists.

    ``negative_first`` keeps "inactive" and "non-toxic" out of the positives; ``positive_first`` is the
    historical behaviour in which "inactive" matches "active".
    """
    norm = F.lower(F.trim(text))
    is_neg, is_pos = mentions_any(norm, negative), mentions_any(norm, positive)
    if order == "negative_first":
        return F.when(is_neg, F.lit(0)).when(is_pos, F.lit(1))
    if order == "positive_first":
        return F.when(is_pos, F.lit(1)).when(is_neg, F.lit(0))
    raise ValueError(f"unknown rule order {order!r}")


def endpoint_label(text: Column, endpoint: str, order: str = "negative_first") -> Column:
    """Label from the phrase lists of one endpoint; other endpoints use the general lists."""
    lists = ENDPOINT_PHRASES.get(endpoint)
    if lists is None:
        return label_by_rules(text, order=order)
    return label_by_rules(text, lists["positive"], lists["negative"], order)


def label_by_value(
    value: Column, units: Column, cut: float = CYTOTOX_CUT, accepted: Sequence[str] = MICROMOLAR_UNITS
) -> Column:
    """1 below the cut, 0 otherwise; null for other units or values that are not numbers."""
    number = value.try_cast("double")
    return F.when(F.lower(units).isin(*accepted) & number.isNotNull(), (number < F.lit(cut)).cast("int"))


def label_contains(text: Column, order: str = "negative_first") -> Column:
    """Binary label of a free-form class column: positive/toxic wording or "1" is 1, the rest 0.

    ``positive_first`` keeps the historical reading of "non-toxic" as toxic.
    """
    norm = F.lower(text)
    says_yes = F.contains(norm, F.lit("positive")) | F.contains(norm, F.lit("toxic")) | (norm == F.lit("1"))
    if order == "negative_first":
        negated = mentions_any(norm, ("non-toxic", "nontoxic", "not toxic", "non toxic"))
        says_yes = says_yes & ~negated
    return F.when(says_yes, F.lit(1)).otherwise(F.lit(0))


def label_text(label: Column, endpoint: str | Column) -> Column:
    """Readable label; ``endpoint`` is a name or a column holding names."""
    if isinstance(endpoint, str):
        yes, no = LABEL_TEXT.get(endpoint, DEFAULT_LABEL_TEXT)
        return F.when(label == 1, F.lit(yes)).when(label.isNotNull(), F.lit(no))
    yes_text, no_text = F.lit(DEFAULT_LABEL_TEXT[0]), F.lit(DEFAULT_LABEL_TEXT[1])
    for name, (yes, no) in LABEL_TEXT.items():
        yes_text = F.when(endpoint == name, F.lit(yes)).otherwise(yes_text)
        no_text = F.when(endpoint == name, F.lit(no)).otherwise(no_text)
    return F.when(label == 1, yes_text).when(label.isNotNull(), no_text)
