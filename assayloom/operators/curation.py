"""Cleaning, labelling and keyed de-duplication of activity tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.labels import endpoint_label, label_by_rules, label_by_value, label_text
from assayloom.operators.ordered import first_by, first_present, median_by_key
from assayloom.sources.tables import resolve_alias

# Molecular weight window, rows needed for the regression route, kept columns.
MIN_WEIGHT, MAX_WEIGHT = 100.0, 900.0
MIN_REGRESSION_ROWS = 100
LABELLED_COLUMNS = ("canonical_smiles", "molecule_id", "activity_label", "activity_comment", "task_type")


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Text to double; what cannot be read, NaN and infinite values become null."""
    number = F.col(column).try_cast("double")
    return df.withColumn(column, F.when(F.abs(number) < float("inf"), number))


def keep_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def range_filter(df: DataFrame, column: str, low: float = MIN_WEIGHT, high: float = MAX_WEIGHT) -> DataFrame:
    """Inclusive range; values that are not numbers count as 0.

    A numeric column is compared as it is, and a whole-number column with whole bounds, so that the
    bounds reach the scan.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        low, high = math.ceil(low), math.floor(high)
    value = F.col(column) if isinstance(kind, T.NumericType) else F.col(column).try_cast("double")
    inside = value.between(low, high)
    return df.where(inside | value.isNull() if low <= 0 <= high else inside)


def add_const(df: DataFrame, value: str, column: str = "task_type") -> DataFrame:
    return df.withColumn(column, F.lit(value))


def nan_inf_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    from assayloom.functions.scores import finite_or_null

    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns})


def detect_task(columns: Sequence[str]) -> tuple[str, str]:
    """(task, target column) from the columns that exist."""
    if "activity_label" in columns:
        return "classification", "activity_label"
    return "regression", "pchembl_value"


def route_task(df: DataFrame, endpoint: str, structure: str = "canonical_smiles", value: str = "pchembl_value") -> str:
    """Which cleaning route applies: 'preprocessed', 'regression' or 'classification'.

    The probe for the regression route stops after the needed number of rows.
    """
    if {"activity_label", "std_smiles"} <= set(df.columns):
        return "preprocessed"
    if endpoint == "herg":
        return "regression"
    if value in df.columns:
        usable = drop_missing(df.select(structure, value), [structure, value])
        if usable.limit(MIN_REGRESSION_ROWS).count() >= MIN_REGRESSION_ROWS:
            return "regression"
    return "classification"


def encode_binary(df: DataFrame, column: str, order: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Two-class target to 0/1.

    {0, 1} stays; two other numbers map in ascending order; two strings map by first appearance in
    ``order``. Nulls and any other number of classes are errors. At most three classes are looked at.
    """
    appear = F.min(F.struct(*order)) if order else F.min(column)
    seen = df.groupBy(column).agg(appear.alias("_seen"))
    few = seen.orderBy("_seen").limit(3).select(column).collect()
    values = [r[0] for r in few]
    if any(v is None for v in values) or not df.where(F.col(column).isNull()).isEmpty():
        raise ValueError(f"target {column} has missing values")
    if len(values) != 2:
        raise ValueError(f"target {column} has {'more than 2' if len(values) > 2 else len(values)} classes")
    try:
        zero, one = sorted(values, key=float)
    except (TypeError, ValueError):
        zero, one = values
    return df.withColumn(name or column, F.when(F.col(column) == F.lit(zero), 0).when(F.col(column) == F.lit(one), 1))


def dedup_median(
    df: DataFrame, key: str, value: str, firsts: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """One row per key: exact median of the value and the first non-null of the other columns."""
    rows = df.where(F.col(key).isNotNull())
    return median_by_key(rows, [key], value, value, [first_present(c, order) for c in firsts])


def dedup_majority(df: DataFrame, key: str, label: str, firsts: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One row per key: most frequent label, the smallest on ties; first non-null of other columns.

    Labels have few distinct values, so the per-key buffers stay tiny and combine before the shuffle.
    """
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.mode(F.col(label), True).alias(label), *[first_present(c, order) for c in firsts])
    )


def drop_duplicates(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order (a plain distinct picks any row)."""
    return first_by(df, keys, order)


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def imbalance(df: DataFrame, label: str) -> DataFrame:
    """One row: number of classes, smallest and largest class, their ratio."""
    return class_counts(df, label).agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("n").alias("minority"),
        F.max("n").alias("majority"),
        F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("ratio"),
    )


def build_labelled(
    df: DataFrame,
    endpoint: str,
    structure: str = "canonical_smiles",
    comment: str = "activity_comment",
    value: str | None = None,
    units: str | None = None,
    order: Sequence[str] = ("pos",),
    rule_order: str = "negative_first",
) -> DataFrame:
    """Endpoint fetch result to labelled compounds: rules, value rule, label text, first row per structure."""
    label = endpoint_label(F.col(comment), endpoint, rule_order)
    if endpoint == "cytotox" and value is not None:
        label = F.coalesce(label, label_by_value(F.col(value), F.col(units)))
    rows = (
        df.where(F.col(structure).isNotNull())
        .withColumn("activity_label", label)
        .where(F.col("activity_label").isNotNull())
        .withColumn("activity_comment", label_text(F.col("activity_label"), endpoint))
        .withColumn("task_type", F.lit("classification"))
    )
    kept = [c for c in (structure, *LABELLED_COLUMNS[1:]) if c in rows.columns]
    return first_by(keep_columns(rows, [*kept, *order]), [structure], order).select(*kept)


def curate(
    df: DataFrame,
    endpoint: str,
    order: Sequence[str],
    key: str = "inchikey",
    weight: str = "mol_wt",
    route: str | None = None,
) -> DataFrame:
    """Curated compound table, one row per key, by the route the data allows.

    Structure standardisation, the key and the weight are input columns. Weight belongs to the structure,
    so its filter runs before the shuffle.
    """
    route = route or route_task(df, endpoint)
    have = [c for c in ("std_smiles", "molecule_id", "canonical_smiles", "activity_comment", "drug_name", weight) if c in df.columns]
    rows = range_filter(df.where(F.col(key).isNotNull()), weight)
    if route == "regression":
        rows = coerce_numeric(drop_missing(rows, ["canonical_smiles", "pchembl_value"]), "pchembl_value")
        firsts = [c for c in have if c != "activity_comment"]
        return add_const(dedup_median(rows, key, "pchembl_value", firsts, order), "regression")
    if route == "classification":
        rows = drop_missing(rows, ["canonical_smiles"]).where(F.length("activity_comment") > 0)
        rows = rows.withColumn("activity_label", label_by_rules(F.col("activity_comment")))
        rows = rows.where(F.col("activity_label").isNotNull())
    else:
        rows = drop_missing(rows, ["std_smiles", "activity_label"])
        rows = rows.withColumn("activity_label", F.col("activity_label").cast("int"))
    return add_const(dedup_majority(rows, key, "activity_label", have, order), "classification")


def prepare_regression_table(
    df: DataFrame, preferred: str = "std_smiles", target: str = "pchembl_value", valid: Column | None = None
) -> DataFrame:
    """(smiles, pchembl_value) ready for training; ``valid`` is an optional row check supplied by the caller."""
    structure = resolve_alias(df.columns, preferred)
    if target not in df.columns:
        raise ValueError(f"no target column {target!r}")
    rows = df if valid is None else df.where(valid)
    rows = rows.select(F.trim(F.col(structure)).alias("smiles"), F.col(target).alias("pchembl_value"))
    return drop_missing(coerce_numeric(rows, "pchembl_value"), ["smiles", "pchembl_value"]).where(F.col("smiles") != "")


def profile_activities(df: DataFrame, molecule: str, kind: str, value: str, bins: int = 50) -> dict[str, DataFrame]:
    """Three small tables: distinct molecules, rows per activity type, equal-width histogram of the value."""
    span = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("s")).scalar()
    lo, hi = span["lo"], span["hi"]
    place = F.floor(F.try_divide((F.col(value) - lo) * F.lit(bins), hi - lo))
    histogram = (
        df.where(F.col(value).isNotNull())
        .select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return {
        "molecules": df.agg(F.count_distinct(molecule).alias("n_molecules"), F.count(F.lit(1)).alias("n_rows")),
        "types": df.groupBy(kind).agg(F.count(F.lit(1)).alias("n")),
        "histogram": histogram,
    }
