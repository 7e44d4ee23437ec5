"""Feature-table statistics, filters, imputation and scaling.

A feature table is (key, ARRAY<DOUBLE>) plus a list of names; null marks a missing entry. Statistics are
one pass: entries are unfolded and combined map-side to one row per feature and task. Fitted state is a
table with one row per feature, so it is bounded by the number of features.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.scores import finite_or_null
from assayloom.operators.correlation import pairwise_correlations
from assayloom.operators.quantiles import vector_percentiles

# Limits of the filters.
MAX_MISSING_2D, MAX_MISSING_3D = 0.2, 0.3
MIN_VARIANCE, MAX_CORRELATION, MAX_FEATURES = 0.01, 0.95, 500


def to_array(columns: Sequence[str]) -> Column:
    """Numeric columns as one array with NaN and infinities as null."""
    return F.array(*[finite_or_null(F.col(c)) for c in columns])


def clean_array(vec: str | Column) -> Column:
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(v.cast("array<double>"), lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))


def unfold(df: DataFrame, vec: str, *keep: str) -> DataFrame:
    """Long form (keep..., idx, x)."""
    return df.select(*keep, F.posexplode(F.col(vec)).alias("idx", "x"))


def feature_stats(df: DataFrame, vec: str) -> DataFrame:
    """One row per feature: rows, present, missing_fraction, mean, both variances, both deviations."""
    return (
        unfold(df, vec)
        .groupBy("idx")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("x").alias("n_present"),
            (F.count_if(F.col("x").isNull()) / F.count(F.lit(1))).alias("missing_fraction"),
            F.avg("x").alias("mean"),
            F.var_pop("x").alias("var_pop"),
            F.var_samp("x").alias("var_samp"),
            F.stddev_pop("x").alias("sd_pop"),
            F.stddev_samp("x").alias("sd_samp"),
        )
    )


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same statistics for separate columns, keyed by column name."""
    return feature_stats(df.select(to_array(columns).alias("_v")), "_v").withColumn(
        "feature", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("idx") + 1)
    )


def missing_fraction_filter(stats: DataFrame, most: float = MAX_MISSING_2D, strict: bool = True) -> DataFrame:
    """Features with few enough missing entries: below the limit (2D rule) or up to it (3D rule)."""
    share = F.col("missing_fraction")
    return stats.where(share < most if strict else share <= most)


def zero_std_filter(stats: DataFrame) -> DataFrame:
    return stats.where(F.col("sd_samp") > 0)


def variance_filter(stats: DataFrame, least: float = MIN_VARIANCE) -> DataFrame:
    """Population variance above the limit."""
    return stats.where(F.col("var_pop") > least)


def cap_by_variance(stats: DataFrame, most: int = MAX_FEATURES) -> DataFrame:
    """When more features remain: the top ones by sample variance, in variance-descending order."""
    return stats.orderBy(F.desc("var_samp"), "idx").limit(most)


def feature_medians(df: DataFrame, vec: str) -> DataFrame:
    """Exact median per feature, whatever the number of rows."""
    return vector_percentiles(df, vec, [0.5], ["median"])


def feature_quartiles(df: DataFrame, vec: str) -> DataFrame:
    return vector_percentiles(df, vec, [0.25, 0.5, 0.75], ["q25", "median", "q75"])


def kept_indices(state: DataFrame, order: Sequence[str | Column] = ("idx",)) -> list[int]:
    """Feature places of a state table on the driver (one small integer per feature)."""
    return [r.idx for r in state.orderBy(*order).select("idx").collect()]


def state_array(state: DataFrame, value: str, width: int, default: float | None = None) -> list[float | None]:
    """Per-feature state as a list by place (one number per feature)."""
    found = {r.idx: r.v for r in state.select("idx", F.col(value).alias("v")).collect()}
    return [found.get(i) if found.get(i) is not None else default for i in range(width)]


def literal_array(values: Sequence[float | None]) -> Column:
    return F.lit([float("nan") if v is None else float(v) for v in values]) if values else F.array().cast("array<double>")


def impute_median(df: DataFrame, vec: str, medians: DataFrame, width: int, zero_left: bool = False) -> DataFrame:
    """Fill nulls by the fitted medians; features without any value become 0 when asked, else stay null."""
    fill = literal_array(state_array(medians, "median", width, 0.0 if zero_left else None))
    filled = F.zip_with(F.col(vec), fill, lambda x, m: F.coalesce(x, F.nanvl(m, F.lit(None).cast("double"))))
    return df.withColumn(vec, filled)


def select_places(df: DataFrame, vec: str, places: Sequence[int]) -> DataFrame:
    """Keep the given places of the array, in the given order.

    The array is walked once: its elements get the rank of their place, and for places out of order the
    kept pairs are sorted by it.
    """
    places = list(places)
    ranks = [None] * (max(places) + 1 if places else 0)
    for rank, place in enumerate(places):
        ranks[place] = rank
    lookup = F.array(*[F.lit(r).cast("int") for r in ranks]) if ranks else F.array().cast("array<int>")
    if places == sorted(places):
        return df.withColumn(vec, F.filter(F.col(vec), lambda x, i: F.get(lookup, i).isNotNull()))
    ranked = F.transform(F.col(vec), lambda x, i: F.struct(F.get(lookup, i).alias("r"), x.alias("x")))
    kept = F.array_sort(F.filter(ranked, lambda e: e["r"].isNotNull()))
    return df.withColumn(vec, F.transform(kept, lambda e: e["x"]))


def fit_standard(df: DataFrame, vec: str) -> DataFrame:
    """Mean and population deviation per feature; a zero deviation counts as 1."""
    return feature_stats(df, vec).select(
        "idx", F.col("mean").alias("centre"), F.when(F.col("sd_pop") > 0, F.col("sd_pop")).otherwise(1.0).alias("scale")
    )


def fit_robust(df: DataFrame, vec: str) -> DataFrame:
    """Median and interquartile range per feature; a zero range counts as 1."""
    width = F.col("q75") - F.col("q25")
    return feature_quartiles(df, vec).select(
        "idx", F.col("median").alias("centre"), F.when(width > 0, width).otherwise(1.0).alias("scale")
    )


def scale(df: DataFrame, vec: str, state: DataFrame, inverse: bool = False) -> DataFrame:
    """(x - centre) / scale by a fitted state, or back."""
    rows = state.orderBy("idx").collect()
    pairs = F.arrays_zip(
        F.col(vec).alias("x"), F.lit([r.centre for r in rows]).alias("c"), F.lit([r.scale for r in rows]).alias("s")
    )
    forward = lambda e: (e["x"] - e["c"]) / e["s"]
    back = lambda e: e["x"] * e["s"] + e["c"]
    return df.withColumn(vec, F.transform(pairs, back if inverse else forward))


def correlated_places(df: DataFrame, vec: str, most: float = MAX_CORRELATION) -> set[int]:
    """Places j whose absolute correlation with any earlier place exceeds the limit, dropped or not.

    Every pair is judged on the rows in which both values are present; undefined correlations are ignored. Only
    the places reach the driver.
    """
    over = pairwise_correlations(df, vec).where(F.abs("r") > most)
    return {row.j for row in over.select("j").distinct().collect()}


def fit_descriptor_cleaning(train: DataFrame, vec: str) -> DataFrame:
    """State of the 2D cleaning: few missing, not constant, median for the gaps. Fitted on training rows."""
    stats = zero_std_filter(missing_fraction_filter(feature_stats(train, vec)))
    return stats.join(feature_medians(train, vec), "idx").select("idx", "median")


def apply_cleaning(df: DataFrame, vec: str, state: DataFrame) -> DataFrame:
    """Keep the state's features and fill their gaps."""
    rows = state.orderBy("idx").collect()
    kept = select_places(df, vec, [r.idx for r in rows])
    fill = F.lit([float(r.median) for r in rows])
    return kept.withColumn(vec, F.zip_with(F.col(vec), fill, lambda x, m: F.coalesce(x, m)))


def clean_descriptors(df: DataFrame, vec: str, train: Column) -> DataFrame:
    """Fit on the training rows, apply to all."""
    cleaned = df.withColumn(vec, clean_array(vec))
    return apply_cleaning(cleaned, vec, fit_descriptor_cleaning(cleaned.where(train), vec))


def select_features(
    df: DataFrame,
    vec: str,
    names: Sequence[str],
    train: Column,
    variance: float = MIN_VARIANCE,
    correlation: float = MAX_CORRELATION,
    most: int = MAX_FEATURES,
) -> tuple[DataFrame, DataFrame]:
    """(reduced table, state): variance, then correlation, then the cap, all fitted on training rows.

    The state lists the kept names with their place in the reduced vector and in the original one.
    """
    fitted_on = df.where(train)
    stats = feature_stats(fitted_on, vec)
    varied = kept_indices(variance_filter(stats, variance))
    if not varied:
        raise ValueError("no feature passes the variance limit")
    reduced = select_places(fitted_on, vec, varied)
    dropped = correlated_places(reduced, vec, correlation)
    left = [place for i, place in enumerate(varied) if i not in dropped]
    if len(left) > most:
        left = kept_indices(cap_by_variance(stats.where(F.col("idx").isin(left)), most), (F.desc("var_samp"), "idx"))
    state = df.sparkSession.createDataFrame(
        [(i, place, names[place]) for i, place in enumerate(left)], "idx int, source_idx int, feature string"
    )
    return select_places(df, vec, left), state


def apply_selection(df: DataFrame, vec: str, names: Sequence[str], state: DataFrame) -> DataFrame:
    """Pick the saved features by name from a table with its own feature order."""
    wanted = [r.feature for r in state.orderBy("idx").collect()]
    where = {n: i for i, n in enumerate(names)}
    missing = [n for n in wanted if n not in where]
    if missing:
        raise ValueError(f"missing {len(missing)} expected features: {missing[:5]}")
    return select_places(df, vec, [where[n] for n in wanted])


def clean_feature_matrix(
    df: DataFrame,
    vec: str,
    names: Sequence[str],
    train: Column | None = None,
    most_missing: float = MAX_MISSING_3D,
    variance: float = MIN_VARIANCE,
    correlation: float = MAX_CORRELATION,
) -> tuple[DataFrame, list[str]]:
    """3D variant: missing, median (0 for empty features), variance, correlation, standard scale.

    ``train`` restricts what is fitted; without it all rows are used.
    """
    table = df.withColumn(vec, clean_array(vec))
    fit = table if train is None else table.where(train)
    kept = kept_indices(missing_fraction_filter(feature_stats(fit, vec), most_missing, strict=False))
    medians = dict((r.idx, r.median) for r in feature_medians(fit, vec).collect())
    fill = F.lit([float(medians.get(i, 0.0)) for i in kept])

    def reduce(rows):
        return select_places(rows, vec, kept).withColumn(
            vec, F.zip_with(F.col(vec), fill, lambda x, m: F.coalesce(x, m))
        )

    table, fit = reduce(table), reduce(fit)
    varied = kept_indices(variance_filter(feature_stats(fit, vec), variance))
    if not varied:
        raise ValueError("all features were removed by filtering")
    dropped = correlated_places(select_places(fit, vec, varied), vec, correlation)
    final = [p for i, p in enumerate(varied) if i not in dropped]
    table, fit = select_places(table, vec, final), select_places(fit, vec, final)
    return scale(table, vec, fit_standard(fit, vec)), [names[kept[p]] for p in final]


def featurize_once(
    df: DataFrame,
    key: str,
    text: str,
    fn: Callable[[str], Sequence[float]],
    cache: DataFrame | None = None,
) -> DataFrame:
    """(key, features, failed): a per-row user function, run once per distinct key not in the cache.

    A failing or non-finite row gives null features and failed=true. Keys pass through unchanged; a null key is
    a key like any other.
    """
    todo = df.select(key, text).groupBy(key).agg(F.min(text).alias(text))
    if cache is not None:
        known = cache.select(F.col(key).alias("_known"))
        todo = todo.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
    schema = T.StructType([todo.schema[key], T.StructField("features", T.ArrayType(T.DoubleType())), T.StructField("failed", T.BooleanType())])

    def one(value):
        try:
            out = [float(x) for x in fn(value)]
            return out if all(map(math.isfinite, out)) else None
        except Exception:  # noqa: BLE001 - any failure of the user's function marks the row
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(v) for v in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(out, pa.list_(pa.float64())), pa.array([o is None for o in out])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "features", "failed"])

    fresh = todo.mapInArrow(run, schema)
    return fresh if cache is None else cache.unionByName(fresh)


def failure_count(features: DataFrame) -> DataFrame:
    return features.agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("n_failed"))
