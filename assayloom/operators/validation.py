"""Fold summaries, paired tests, target checks and reports over metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.functions.tdist import two_sided_p
from assayloom.operators.lookup import paired_folds

# Target thresholds per endpoint, comparison per metric, preference of model families.
TARGETS = {
    "herg": {"r2": 0.85, "rmse": 0.60},
    "hepatotox": {"r2": 0.80, "sensitivity": 0.85},
    "nephrotox": {"r2": 0.70},
    "ames": {"accuracy": 0.80, "sensitivity": 0.80, "specificity": 0.80},
    "skin_sens": {"accuracy": 0.75, "sensitivity": 0.75},
    "cytotox": {"accuracy": 0.80, "sensitivity": 0.80},
    "reproductive_tox": {"accuracy": 0.75, "sensitivity": 0.80, "specificity": 0.75},
}
AT_LEAST = ("r2", "accuracy", "f1", "auc", "sensitivity", "specificity", "mcc")
AT_MOST = ("rmse",)
MODEL_PREFERENCE = ("xgboost", "randomforest", "lightgbm", "svc", "svr")
STAGE_PREFERENCE = ("optimized", "baseline")
COMPARISONS = (("2D", "3D"), ("2D", "Hybrid"))
SIGNIFICANT_BELOW = 0.05


def target_table(spark: SparkSession, targets: dict[str, dict[str, float]] = TARGETS) -> DataFrame:
    rows = [
        (endpoint, metric, "<=" if metric in AT_MOST else ">=", float(cut))
        for endpoint, checks in targets.items()
        for metric, cut in checks.items()
    ]
    return spark.createDataFrame(rows, "endpoint string, metric string, op string, threshold double")


def unpivot_metrics(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return df.unpivot(list(ids), [c for c in metrics], "metric", "value")


def cv_summary(folds: DataFrame, by: Sequence[str], value: str = "value", ddof: int = 0) -> DataFrame:
    """Mean and deviation over folds; ddof 1 also gives the text "m +/- s"."""
    spread = F.stddev_pop(value) if ddof == 0 else F.stddev_samp(value)
    out = folds.groupBy(*by).agg(F.avg(value).alias("mean"), spread.alias("sd"), F.count(value).alias("n_folds"))
    return out if ddof == 0 else out.withColumn("mean_sd", F.format_string("%.4f +/- %.4f", F.col("mean"), F.col("sd")))


def paired_ttest(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Paired t-test over left_value / right_value: means, difference, t, two-sided p, flag."""
    d = F.col("left_value") - F.col("right_value")
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("left_value").alias("mean_left"),
        F.avg("right_value").alias("mean_right"),
        F.avg(d).alias("mean_difference"),
        F.stddev_samp(d).alias("_sd"),
    )
    t = F.try_divide(F.col("mean_difference"), F.col("_sd") / F.sqrt("n_folds"))
    tested = sums.withColumn("t_statistic", t)
    p = two_sided_p(F.col("t_statistic"), F.col("n_folds") - 1)
    return tested.withColumn("p_value", p).withColumn("significant", F.col("p_value") < SIGNIFICANT_BELOW).drop("_sd")


def compare_folds(metrics: DataFrame, comparisons=COMPARISONS) -> DataFrame:
    """All stated comparisons per model, ordered by model and comparison."""
    out = None
    for left, right in comparisons:
        part = paired_ttest(paired_folds(metrics, left, right)).withColumn("comparison", F.lit(f"{left} vs {right}"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("model", "comparison")


def check_targets(metrics: DataFrame, targets: DataFrame, ids: Sequence[str]) -> DataFrame:
    """(ids, endpoint, metric, met) for every metric with a target, from a long metric table.

    The target table has a few rows per endpoint.
    """
    ok = F.when(F.col("op") == ">=", F.col("value") >= F.col("threshold")).otherwise(F.col("value") <= F.col("threshold"))
    return metrics.where(F.col("value").isNotNull()).join(targets, ["endpoint", "metric"]).select(
        *ids, "endpoint", "metric", ok.alias("met")
    )


def all_targets_met(metrics: DataFrame, targets: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per model: true when every checked target is met, false when none was checked."""
    checked = check_targets(metrics, targets, ids).groupBy(*ids, "endpoint").agg(F.bool_and("met").alias("met"))
    models = metrics.select(*ids, "endpoint").distinct()
    return models.join(checked, [*ids, "endpoint"], "left").withColumn("all", F.coalesce("met", F.lit(False))).drop("met")


def compatible_models(models: DataFrame, task: str, n_features: int) -> DataFrame:
    """Model registry rows with the reason why a model is left out (null = kept)."""
    reason = F.when(F.col("task") != task, F.lit(f"not a {task} model")).when(
        F.col("n_features") != n_features,
        F.concat(F.lit("feature mismatch: expects "), F.col("n_features").cast("string"), F.lit(f", got {n_features}")),
    )
    return models.withColumn("skip_reason", reason)


def best_by(metrics: DataFrame, score: str, by: Sequence[str], order: str) -> DataFrame:
    """Model with the highest score per group; the first in order wins ties."""
    return metrics.where(F.col(score).isNotNull()).groupBy(*by).agg(
        F.max_by("model", F.struct(F.col(score), -F.col(order))).alias("best_model"), F.max(score).alias("best_score")
    )


def preference_rank(name: Column, preference: Sequence[str]) -> Column:
    rank = F.lit(len(preference))
    for i, word in reversed(list(enumerate(preference))):
        rank = F.when(F.contains(F.lower(name), F.lit(word)), F.lit(i)).otherwise(rank)
    return rank


def best_model(models: DataFrame, by: Sequence[str], name: str = "artifact") -> DataFrame:
    """Preferred saved model per endpoint: optimised before baseline, then by family, then by name."""
    rank = F.struct(
        preference_rank(F.col(name), STAGE_PREFERENCE).alias("stage"),
        preference_rank(F.col(name), MODEL_PREFERENCE).alias("family"),
        F.col(name).alias("name"),
    )
    known = preference_rank(F.col(name), STAGE_PREFERENCE) < len(STAGE_PREFERENCE)
    return models.where(known).groupBy(*by).agg(F.min_by(name, rank).alias("best_model"))


def validation_report(
    metrics: DataFrame, cv: DataFrame | None, targets: DataFrame, domain: DataFrame | None, task: str, order: str = "pos"
) -> DataFrame:
    """One nested row per endpoint: models (metrics, cv, target checks), best model, counts, coverage.

    ``metrics`` is wide: endpoint, model, pos, metric columns.
    """
    score = "f1" if task == "classification" else "r2"
    values = [c for c in metrics.columns if c not in ("endpoint", "model", order)]
    checks = [c for c in values if c in AT_LEAST + AT_MOST]
    long = unpivot_metrics(metrics.select("endpoint", "model", *[F.col(c).cast("double") for c in checks]), ["endpoint", "model"], checks)
    met = check_targets(long, targets, ["model"]).groupBy("endpoint", "model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "met")))).alias("meets_targets"),
        F.bool_and("met").alias("_all"),
    )
    rows = metrics.join(met, ["endpoint", "model"], "left").withColumn("meets_all", F.coalesce("_all", F.lit(False)))
    if cv is not None:
        cv_rows = cv.groupBy("endpoint", "model").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "sd").alias("v"))))).alias("cv")
        )
        rows = rows.join(cv_rows, ["endpoint", "model"], "left")
    inner = ["model", *values, "meets_targets", "meets_all", *(["cv"] if cv is not None else [])]
    report = rows.groupBy("endpoint").agg(
        F.collect_list(F.struct(order, F.struct(*inner).alias("model"))).alias("_models"),
        F.max_by("model", F.struct(F.col(score), -F.col(order))).alias("best_model"),
        F.max(score).alias("best_score"),
        F.count(F.lit(1)).alias("n_models_evaluated"),
    )
    ordered = F.array_sort("_models", lambda a, b: (a[order] - b[order]).cast("int"))
    report = report.withColumn("models", F.transform(ordered, lambda m: m["model"])).drop("_models")
    report = report.withColumn("task_type", F.lit(task))
    if domain is not None:
        report = report.join(domain.select("endpoint", F.col("coverage").alias("ad_coverage")), "endpoint", "left")
    return report


def sort_summary(df: DataFrame, second: str = "representation") -> DataFrame:
    return df.orderBy("model", second)


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
