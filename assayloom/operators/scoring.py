"""Applying fitted models: endpoints, domain flags, attributions, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.labels import label_text
from assayloom.operators.domain import Domain, add_domain_value, domain_flag
from assayloom.operators.explain import top_of_array
from assayloom.operators.features import scale
from assayloom.operators.lookup import ENDPOINTS


@dataclass(frozen=True)
class EndpointModel:
    """What scoring one endpoint needs: scaler state, fitted model, domain, task."""

    endpoint: str
    task: str
    name: str
    model: Transformer
    scaler: DataFrame
    domain: Domain | None = None
    unit: str | None = None


def _with_result(df: DataFrame, vec: str, em: EndpointModel, name: str) -> DataFrame:
    """Adds one struct column with the endpoint's result for every row.

    Rows without usable features pass the model as zeros, so that they need no separate scan, and get
    an error instead of its answer.
    """
    before = df.columns
    width = em.scaler.count()
    features = F.col(vec)
    usable = F.coalesce(
        (F.size(vec) == width) & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x)), F.lit(False)
    )
    rows = df.withColumn("_ok", usable).withColumn(
        "_v", F.when(F.col("_ok"), features).otherwise(F.array_repeat(F.lit(0.0), width))
    )
    out = em.model.transform(scale(rows, "_v", em.scaler).withColumn("x", array_to_vector("_v")))
    within = None
    if em.domain is not None:
        out = add_domain_value(out, "_v", em.domain, "_h")
        within = F.col("_h") <= F.lit(em.domain.threshold)
    classified = em.task == "classification"
    good = F.col("_ok")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    result = F.struct(
        F.lit(em.endpoint).alias("endpoint"),
        F.lit(em.task).alias("task_type"),
        good.alias("success"),
        F.when(~good, F.lit("Invalid input")).alias("error"),
        F.when(good, F.col("prediction").cast("double")).alias("prediction"),
        F.when(good, label_text(F.col("prediction"), em.endpoint) if classified else no_text).alias("label"),
        F.when(good, vector_to_array("probability")[1] if classified else no_number).alias("probability"),
        F.lit(em.unit).cast("string").alias("unit"),
        F.when(good, domain_flag(within)).alias("applicability_domain"),
        F.lit(em.name).alias("model"),
    )
    return out.select(*before, result.alias(name))


def score_all(df: DataFrame, key: str, vec: str, models: Sequence[EndpointModel]) -> DataFrame:
    """Long table (key, endpoint, ...) over all endpoint models.

    The feature table is read once: every model adds its result to the row, and the row is unfolded at the
    end. Rows without usable features keep success=false and an error text.
    """
    rows = df.select(key, vec)
    names = [f"_r{i}" for i in range(len(models))]
    for name, em in zip(names, models):
        rows = _with_result(rows, vec, em, name)
    return rows.select(key, F.inline(F.array(*names)))


def score_endpoint(df: DataFrame, key: str, vec: str, em: EndpointModel) -> DataFrame:
    return score_all(df, key, vec, [em])


def multi_endpoint_map(scored: DataFrame, key: str) -> DataFrame:
    """One row per key with a map endpoint -> result over all endpoints that occur, for the sink."""
    rest = [c for c in scored.columns if c not in (key, "endpoint")]
    one = scored.where(F.col("endpoint").isNotNull()).groupBy(key, "endpoint").agg(F.any_value(F.struct(*rest)).alias("result"))
    entries = one.groupBy(key).agg(F.collect_list(F.struct("endpoint", "result")).alias("e"))
    return entries.select(key, F.map_from_entries("e").alias("results"))


def prediction_column(df: DataFrame, target: str) -> str:
    """The prediction column of an external result table: a numeric column named after the target, else
    the last numeric one, else the target column itself."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    named = [c for c in numeric if target in c.lower() and c != target]
    rest = [c for c in numeric if c != target]
    if named or rest:
        return named[0] if named else rest[-1]
    if target in numeric:
        return target
    raise ValueError(f"no prediction column among {df.columns}")


def aligned_predictions(
    predicted: DataFrame, truth: DataFrame, key: str, target: str, fold: int, split: str = "cv_val", predictor: str | None = None
) -> DataFrame:
    """(fold, split, key, y_true, y_pred): external predictions with the truth of their split, by key."""
    column = predictor or prediction_column(predicted.drop(key), target)
    return truth.select(key, F.col(target).cast("double").alias("y_true")).join(
        predicted.select(key, F.col(column).cast("double").alias("y_pred")), key
    ).select(F.lit(fold).alias("fold"), F.lit(split).alias("split"), key, "y_true", "y_pred")


def linear_explanation(
    df: DataFrame, key: str, vec: str, coefficients: Sequence[float], means: Sequence[float], names: Sequence[str],
    intercept: float = 0.0, k: int = 10,
) -> DataFrame:
    """Per row: base value, sum of contributions, score, and the top-k contributions with their category."""
    from assayloom.operators.explain import linear_attribution

    base = float(intercept) + float(sum(c * m for c, m in zip(coefficients, means)))
    rows = linear_attribution(df.select(key, vec), vec, coefficients, means)
    return rows.select(
        key,
        F.lit(base).alias("base_value"),
        "attribution_sum",
        (F.lit(base) + F.col("attribution_sum")).alias("score"),
        top_of_array(F.col("contributions"), k, names).alias("top_features"),
    )
