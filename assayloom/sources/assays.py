"""Assay and activity scans, name lists and fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.operators.ordered import small_side

# Search words per endpoint, and how many assays are kept per word.
ENDPOINT_KEYWORDS = {
    "hepatotox": ("hepatotoxicity", "DILI", "liver toxicity"),
    "nephrotox": ("nephrotoxicity", "kidney toxicity", "renal toxicity"),
    "ames": ("ames", "mutagenicity", "salmonella", "bacterial reverse mutation"),
    "cytotox": ("cytotoxicity", "cytotoxic", "cell viability", "MTT assay", "LDH release", "cell death"),
    "skin_sens": (
        "skin sensitization", "LLNA", "local lymph node", "contact dermatitis",
        "allergic contact", "KeratinoSens", "h-CLAT", "DPRA",
    ),
    "reproductive_tox": (
        "reproductive toxicity", "developmental toxicity", "teratogenicity", "teratogenic",
        "embryotoxicity", "fertility", "DART",
    ),
}
ASSAYS_PER_KEYWORD = {"hepatotox": 50, "nephrotox": 50}
DEFAULT_ASSAYS_PER_KEYWORD = 30
# Activity types and potency floor of the regression endpoint.
POTENCY_TYPES = ("IC50", "Ki", "Kd")
MIN_PCHEMBL = 4.0
MIN_PRIMARY_ROWS = 100


def scan_activities(
    df: DataFrame, target_col: str, target: str, type_col: str, types: Sequence[str], value_col: str, floor: float
) -> DataFrame:
    """Activities of one target, of the given types, at or above a potency floor (pushed to the scan)."""
    return df.where((F.col(target_col) == target) & F.col(type_col).isin(*types) & (F.col(value_col) >= floor))


def keyword_assays(
    assays: DataFrame, assay_id: str, description: str, keywords: Sequence[str], top_n: int, order: Sequence[str] | None = None
) -> DataFrame:
    """(keyword, assay_id, place): the first ``top_n`` assays per keyword whose description contains it.

    Keywords are a short literal list, so each row yields its own matches: no join. The row-number bound
    is applied before the shuffle as well as after it, which keeps a keyword found everywhere small.
    """
    text = F.lower(F.col(description))
    matches = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, F.lower(k)))
    by_keyword = W.partitionBy("keyword").orderBy(*(order or [assay_id]))
    return (
        assays.select(assay_id, *(order or []), F.explode(matches).alias("keyword"))
        .withColumn("place", F.row_number().over(by_keyword))
        .where(F.col("place") <= top_n)
        .select("keyword", assay_id, "place")
    )


def activities_for_assays(
    hits: DataFrame, activities: DataFrame, assay_id: str, require: str | None = None
) -> DataFrame:
    """Activities of every hit; an assay hit by two keywords contributes its rows twice.

    Hits of :func:`keyword_assays` are at most keywords x top_n rows; they are broadcast after a count.
    """
    rows = activities if require is None else activities.where(F.length(F.col(require).cast("string")) > 0)
    return rows.join(small_side(hits), assay_id)


def curated_list(
    positives: DataFrame, negatives: DataFrame, name: str, pos_comment: str, neg_comment: str
) -> DataFrame:
    """Two name lists to labelled rows (drug_name, activity_label, activity_comment)."""

    def rows(df, label, comment):
        return df.select(
            F.col(name).alias("drug_name"),
            F.lit(label).alias("activity_label"),
            F.lit(comment).alias("activity_comment"),
        )

    return rows(positives, 1, pos_comment).unionByName(rows(negatives, 0, neg_comment))


def source_or_fallback(
    primary: DataFrame, fallback: DataFrame, min_rows: int = MIN_PRIMARY_ROWS, cache_path: str | None = None
) -> DataFrame:
    """The primary table when it has ``min_rows`` rows, else the fallback; a cached table wins over both.

    The probe stops after ``min_rows`` rows.
    """
    spark = primary.sparkSession
    if cache_path is not None:
        try:
            return spark.read.parquet(cache_path)
        except AnalysisException:
            pass
    chosen = primary if primary.limit(min_rows).count() >= min_rows else fallback
    if cache_path is not None:
        chosen.write.mode("overwrite").parquet(cache_path)
        return spark.read.schema(chosen.schema).parquet(cache_path)
    return chosen


def union_all(*parts: DataFrame) -> DataFrame:
    """Concatenation by column name; columns missing on one side become null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
