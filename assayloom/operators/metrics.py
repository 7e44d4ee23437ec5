"""Regression, classification and ranking metrics, grouped.

Everything except the ranking metrics is one map-side combined aggregation. The ranking metrics count by
distinct score first and use running totals over bounded bins, so no group is ordered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.ordered import running_totals


def safe(numerator: Column, denominator: Column, default: float | None = 0.0) -> Column:
    """Quotient with a stated value where the denominator is 0."""
    q = F.when(denominator != 0, F.try_divide(numerator, denominator))
    return q if default is None else F.coalesce(q, F.lit(default))


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """r2, rmse, mae, mse, explained variance, q2, ccc (population moments), residual moments, max error, n."""
    t, e = F.col(y), F.col(y) - F.col(p)
    sums = df.where(t.isNotNull() & F.col(p).isNotNull()).groupBy(*by).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e).alias("residual_mean"),
        F.var_pop(e).alias("_ve"),
        F.max(F.abs(e)).alias("max_abs_error"),
        F.var_pop(t).alias("_vt"),
        F.var_pop(p).alias("_vp"),
        F.covar_pop(y, p).alias("_cov"),
        (F.avg(t) - F.avg(p)).alias("_shift"),
        F.count(F.lit(1)).alias("n"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_vt"))
    return sums.select(
        *by,
        r2.alias("r2"),
        F.sqrt("mse").alias("rmse"),
        "mae",
        "mse",
        (F.lit(1.0) - F.try_divide(F.col("_ve"), F.col("_vt"))).alias("explained_variance"),
        r2.alias("q2"),
        safe(F.col("_cov") * 2, F.col("_vt") + F.col("_vp") + F.col("_shift") * F.col("_shift")).alias("ccc"),
        "residual_mean",
        F.sqrt("_ve").alias("residual_std"),
        "max_abs_error",
        "n",
    )


def cv_q2(
    validation: DataFrame, train_means: DataFrame, y: str, p: str, by: Sequence[str], fold: Sequence[str] | None = None
) -> DataFrame:
    """1 - SSres / sum (y - mean of the fold's training y)^2 per group; 0 when the denominator is 0.

    Sums are taken before the join, so only one row per group meets the training means (keyed by ``fold``).
    """
    by = list(by)
    t, e = F.col(y), F.col(y) - F.col(p)
    sums = validation.groupBy(*by).agg(
        F.sum(e * e).alias("_res"), F.var_pop(t).alias("_v"), F.avg(t).alias("_m"), F.count(F.lit(1)).alias("_n")
    )
    gap = F.col("_m") - F.col("train_mean")
    total = F.col("_n") * (F.col("_v") + gap * gap)
    q2 = F.when(total > 0, F.lit(1.0) - F.col("_res") / total).otherwise(0.0)
    return sums.join(train_means, list(fold or by)).select(*by, q2.alias("q2"))


def ccc_sample(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Concordance with sample moments; null below two rows; 1 or 0 when both sides are constant."""
    sums = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp(y).alias("_vy"),
        F.var_samp(p).alias("_vp"),
        F.covar_samp(y, p).alias("_cov"),
        F.avg(y).alias("_my"),
        F.avg(p).alias("_mp"),
    )
    gap = F.col("_my") - F.col("_mp")
    close = F.abs(gap) <= F.lit(1e-8) + F.lit(1e-5) * F.abs("_mp")
    value = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when((F.col("_vy") == 0) & (F.col("_vp") == 0), F.when(close, 1.0).otherwise(0.0))
        .otherwise(F.try_divide(F.col("_cov") * 2, F.col("_vy") + F.col("_vp") + gap * gap))
    )
    return sums.select(*by, "n", value.alias("ccc"))


def confusion(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of a 2x2 table over rows that have both a truth and a prediction."""
    t, q = F.col(y), F.col(p)
    return df.where(t.isNotNull() & q.isNotNull()).groupBy(*by).agg(
        F.count_if((t == 0) & (q == 0)).alias("tn"),
        F.count_if((t == 0) & (q == 1)).alias("fp"),
        F.count_if((t == 1) & (q == 0)).alias("fn"),
        F.count_if((t == 1) & (q == 1)).alias("tp"),
        F.count(F.lit(1)).alias("n"),
    )


def metrics_from_confusion(counts: DataFrame) -> DataFrame:
    """Adds the metrics of a 2x2 table. Undefined ratios are 0; a class without rows has no recall and is
    left out of the balanced mean; specificity and sensitivity are null unless both classes occur in
    truth or prediction."""
    tn, fp, fn, tp, n = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp", "n"))
    pos, neg = tp + fn, tn + fp
    sens, spec = safe(tp, pos, None), safe(tn, neg, None)
    balanced = F.when(pos == 0, spec).when(neg == 0, sens).otherwise((sens + spec) / 2)
    both = (pos + fp > 0) & (neg + fn > 0)
    return counts.select(
        "*",
        safe(tp + tn, n).alias("accuracy"),
        F.coalesce(balanced, F.lit(0.0)).alias("balanced_accuracy"),
        safe(tp, tp + fp).alias("precision"),
        safe(tp, pos).alias("recall"),
        safe(tp * 2, tp * 2 + fp + fn).alias("f1"),
        safe(tp * tn - fp * fn, F.sqrt(tp + fp) * F.sqrt(pos) * F.sqrt(neg) * F.sqrt(tn + fn)).alias("mcc"),
        F.when(both, safe(tn, neg)).alias("specificity"),
        F.when(both, safe(tp, pos)).alias("sensitivity"),
    )


def classification_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    return metrics_from_confusion(confusion(df, y, p, by))


def _by_score(df: DataFrame, score: str, y: str, by: Sequence[str]) -> DataFrame:
    positive, negative = (F.col(y) == 1).cast("long"), (F.col(y) == 0).cast("long")
    return running_totals(df, list(by), score, {"pos": positive, "neg": negative})


def _auc() -> Column:
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    pairs = F.any_value("pos_total").cast("double") * F.any_value("neg_total")
    return safe(won, pairs).alias("auc")


def _average_precision() -> Column:
    pos_from = F.col("pos_total") - F.col("pos_before")
    neg_from = F.col("neg_total") - F.col("neg_before")
    step = F.sum(F.col("pos") * F.try_divide(pos_from.cast("double"), pos_from + neg_from))
    return safe(step, F.any_value("pos_total").cast("double")).alias("average_precision")


def roc_auc(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Tie-aware area under the ROC curve; 0 when only one class occurs."""
    return _by_score(df, score, y, by).groupBy(*by).agg(_auc())


def average_precision(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum over distinct scores of (recall step) x precision; 0 without positives."""
    return _by_score(df, score, y, by).groupBy(*by).agg(_average_precision())


def ranking_metrics(df: DataFrame, score: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., auc, average_precision) from one ordering of the scores."""
    return _by_score(df, score, y, by).groupBy(*by).agg(_auc(), _average_precision())
