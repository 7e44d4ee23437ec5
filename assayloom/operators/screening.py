"""Library screening: best target, wide results, summaries, risk distribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.functions.scores import AFFINITY_HIGH, AFFINITY_MODERATE, affinity_to_risk

# All known targets, in order.
ALL_TARGETS = ("herg", "hepatotox", "cyp3a4", "cyp2d6", "cyp2c9", "ar", "er_alpha")


def _docked():
    return F.coalesce(F.col("success"), F.lit(False)) & F.col("affinity").isNotNull()


def best_target(results: DataFrame, keys: Sequence[str], pos: str = "target_pos") -> DataFrame:
    """Lowest affinity strictly below 0 per compound; the first target wins ties; null when there is none."""
    binds = _docked() & (F.col("affinity") < 0)
    order = F.when(binds, F.struct("affinity", pos))
    return results.groupBy(*keys).agg(
        F.min(F.when(binds, F.col("affinity"))).alias("best_affinity"), F.min_by("target", order).alias("best_target")
    )


def pivot_results(results: DataFrame, keys: Sequence[str], targets: Sequence[str], pos: str = "target_pos") -> DataFrame:
    """One row per compound: best target, then ``<t>_affinity`` and ``<t>_success`` per listed target.

    One aggregation computes all of it; a target that was not run counts as not successful.
    """
    binds = _docked() & (F.col("affinity") < 0)
    columns = [
        F.min(F.when(binds, F.col("affinity"))).alias("best_affinity"),
        F.min_by("target", F.when(binds, F.struct("affinity", pos))).alias("best_target"),
    ]
    for t in targets:
        mine = F.col("target") == t
        columns += [
            F.max(F.when(mine, F.col("affinity"))).alias(f"{t}_affinity"),
            F.coalesce(F.bool_or(F.when(mine, F.col("success"))), F.lit(False)).alias(f"{t}_success"),
        ]
    return results.groupBy(*keys).agg(*columns)


def screen_summary(results: DataFrame, key: Sequence[str] | str) -> DataFrame:
    """Per target: success rate over all compounds, affinity moments, binder classes; only targets with data."""
    keys = [key] if isinstance(key, str) else list(key)
    total = results.agg(F.count_distinct(*keys).alias("n")).select("n").scalar()
    a = F.when(_docked(), F.col("affinity"))
    return (
        results.groupBy("target")
        .agg(
            F.count_if(F.coalesce("success", F.lit(False))).alias("_ok"),
            F.avg(a).alias("mean_affinity"),
            F.min(a).alias("min_affinity"),
            F.max(a).alias("max_affinity"),
            F.stddev_pop(a).alias("std_affinity"),
            F.count_if(a < AFFINITY_HIGH).alias("strong_binders"),
            F.count_if((a >= AFFINITY_HIGH) & (a < AFFINITY_MODERATE)).alias("moderate_binders"),
            F.count_if(a >= AFFINITY_MODERATE).alias("weak_binders"),
            F.count(a).alias("_n"),
        )
        .where(F.col("_n") > 0)
        .select("target", (F.col("_ok") * 100.0 / total).alias("success_rate"), "mean_affinity", "min_affinity",
                "max_affinity", "std_affinity", "strong_binders", "moderate_binders", "weak_binders")
    )


def risk_distribution(best: DataFrame, column: str = "best_affinity") -> DataFrame:
    """Compounds by best affinity: high, moderate, low, no binding data."""
    a = F.col(column)
    return best.agg(
        F.count_if(a < AFFINITY_HIGH).alias("high_risk"),
        F.count_if((a >= AFFINITY_HIGH) & (a < AFFINITY_MODERATE)).alias("moderate_risk"),
        F.count_if((a >= AFFINITY_MODERATE) & (a != 0)).alias("low_risk"),
        F.count_if(a.isNull()).alias("no_binding_data"),
    )


def batch_totals(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("success", F.lit(False))).alias("successful"))


def endpoint_summary(results: DataFrame, keys: Sequence[str], targets: Sequence[str] = ALL_TARGETS) -> DataFrame:
    """Per compound and endpoint: targets, docked, best / mean affinity, enhanced scores, high-risk targets, verdict.

    High-risk targets are a set per group, as large as there are targets; listed ones come first, in list
    order, others behind them by name.
    """
    a = F.when(_docked(), F.col("affinity"))
    place = F.array_position(F.array(*map(F.lit, targets)), F.col("target"))
    listed = F.struct(F.when(place > 0, place).otherwise(F.lit(len(targets) + 1)).alias("place"), F.col("target").alias("target"))
    high = F.collect_set(F.when((F.col("enhanced_risk") == "high") & F.col("target").isNotNull(), listed))
    out = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_targets"),
        F.count(a).alias("successful_docks"),
        F.round(F.min(a), 2).alias("best_affinity"),
        F.round(F.avg(a), 2).alias("avg_affinity"),
        F.round(F.max("enhanced_score"), 4).alias("max_enhanced_score"),
        F.round(F.avg("enhanced_score"), 4).alias("avg_enhanced_score"),
        F.transform(F.array_sort(high), lambda t: t["target"]).alias("high_risk_targets"),
    )
    top = F.coalesce(F.col("max_enhanced_score"), F.lit(0.0))
    verdict = F.when(top >= 0.7, "high").when(top >= 0.4, "moderate").otherwise("low")
    return out.withColumn("overall_risk", verdict)


def docking_features(results: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """dock_<t>_affinity (0 on failure), _score (0.5 on failure) and _success (1 or 0) per key."""
    columns = []
    for t in targets:
        ok = (F.col("target") == t) & F.coalesce(F.col("success"), F.lit(False))
        columns += [
            F.coalesce(F.max(F.when(ok, F.col("affinity"))), F.lit(0.0)).alias(f"dock_{t}_affinity"),
            F.coalesce(F.max(F.when(ok, affinity_to_risk(F.col("affinity")))), F.lit(0.5)).alias(f"dock_{t}_score"),
            F.coalesce(F.max(F.when(ok, F.lit(1.0))), F.lit(0.0)).alias(f"dock_{t}_success"),
        ]
    return results.groupBy(key).agg(*columns)


def override_config(defaults: DataFrame, custom: DataFrame, key: str = "target") -> DataFrame:
    """Custom rows replace default rows of the same key; new keys are added."""
    kept = defaults.join(custom.select(key), key, "left_anti")
    return kept.unionByName(custom, allowMissingColumns=True)
