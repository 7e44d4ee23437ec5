"""Applicability domain of a training table: leverage and distance.

The only thing that leaves the executors is features x features (a triangular factor) or one number per feature.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.features import unfold
from assayloom.operators.ordered import exact_percentiles

# Leverage multiple, distance percentile, confidences of the domain flag.
LEVERAGE_MULTIPLE, DISTANCE_PERCENTILE = 3.0, 95.0
IN_DOMAIN_CONFIDENCE, OUT_OF_DOMAIN_CONFIDENCE = 1.0, 0.5
#: Features at most, rows folded into a triangle at once, and triangles merged into one per round.
MAX_WIDTH, FOLD_ROWS, FAN_IN = 4096, 8192, 8


@dataclass(frozen=True)
class Domain:
    """Fitted domain: method, threshold, training size and the small matrix or centre it needs."""

    method: str
    threshold: float
    n_train: int
    n_features: int
    whitening: tuple[tuple[float, ...], ...] | None = None
    centre: tuple[float, ...] | None = None


def triangular_factor(df: DataFrame, vec: str) -> tuple[np.ndarray, int]:
    """(R, rows) with R'R = X'X: a tall-skinny QR, without forming X'X and squaring its condition.

    Every task folds its rows into one triangle; triangles are merged eight by eight, in as many rounds as the
    logarithm of the number of tasks, and the last one reaches the driver.
    """
    width = df.select(F.size(vec).alias("w")).first().w
    if width > MAX_WIDTH:
        raise ValueError(f"{width} features; select at most {MAX_WIDTH} before the triangular factor")

    def fold(r: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.vstack([r, x]), mode="r")

    def packed(grp: int, n: int, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([grp], pa.int32()), pa.array([n], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["grp", "n", "r"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, width)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, FOLD_ROWS):
                column = batch.column(0).slice(at, FOLD_ROWS)
                r, n = fold(r, column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)), n + len(column)
        if n:
            yield packed(TaskContext.get().partitionId(), n, r)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for grp, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                r = np.frombuffer(blob.as_buffer(), np.float64).reshape(-1, width)
                before, old = held.get(grp, (0, np.zeros((0, width))))
                held[grp] = before + n, fold(old, r)
        for grp, (n, r) in held.items():
            yield packed(grp, n, r)

    kind = "grp int, n long, r binary"
    rows = df.select(F.col(vec).cast("array<double>").alias("v"))
    parts, tasks = rows.mapInArrow(first, kind), rows.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        parts = parts.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int")).repartition(tasks, "grp").mapInArrow(merge, kind)
    found = parts.collect()  # one triangle
    if not found:
        return np.zeros((0, width)), 0
    return np.frombuffer(found[0].r, np.float64).reshape(-1, width), found[0].n


def leverage_threshold(n: int, p: int, multiple: float = LEVERAGE_MULTIPLE) -> float:
    return multiple * (p + 1) / n


def fit_leverage(train: DataFrame, vec: str, multiple: float = LEVERAGE_MULTIPLE) -> Domain:
    """Leverage domain on a scaled table: h = x (X'X)^+ x', from the singular values of the triangular factor.

    Directions whose singular value is rounding beside the greatest one count as absent, so fewer rows than
    features and repeated features do no harm. Falls back to the distance domain when nothing is left or the
    factor cannot be decomposed.
    """
    r, n = triangular_factor(train, vec)
    p = r.shape[1]
    try:
        _, sizes, directions = np.linalg.svd(r, full_matrices=False)
    except np.linalg.LinAlgError:
        return fit_distance(train, vec)
    real = sizes > max(n, p) * np.finfo(float).eps * sizes.max(initial=0.0)
    if not real.any():
        return fit_distance(train, vec)
    whitening = directions[real].T / sizes[real]
    return Domain("leverage", leverage_threshold(n, p, multiple), n, p, whitening=tuple(map(tuple, whitening.tolist())))


def centroid(train: DataFrame, vec: str) -> DataFrame:
    """Mean per feature: (idx, mean)."""
    return unfold(train, vec).groupBy("idx").agg(F.avg("x").alias("mean"))


def distance_to(vec: str, centre: Column) -> Column:
    """Euclidean distance of an array column to an array of the same width."""
    squares = F.zip_with(F.col(vec), centre, lambda x, c: (x - c) * (x - c))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x))


def fit_distance(train: DataFrame, vec: str, percentile: float = DISTANCE_PERCENTILE) -> Domain:
    """Centroid and the percentile of training distances (exact, linear interpolation)."""
    means = [r["mean"] for r in centroid(train, vec).orderBy("idx").collect()]
    distances = train.select(distance_to(vec, F.lit(means)).alias("d"))
    cut = exact_percentiles(distances, [], "d", [percentile / 100.0], ["cut"]).first().cut
    return Domain("distance", float(cut), train.count(), len(means), centre=tuple(means))


def add_domain_value(df: DataFrame, vec: str, domain: Domain, name: str = "h") -> DataFrame:
    """Leverage or distance per row."""
    if domain.method == "distance":
        return df.withColumn(name, distance_to(vec, F.lit(list(domain.centre))))
    whitening = np.array(domain.whitening)

    @F.pandas_udf("double")
    def leverage(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.stack(x.to_numpy()).astype(float)
        return pd.Series(((m @ whitening) ** 2).sum(axis=1))

    # marked so that a filter on the result does not run the function a second time
    once = leverage.asNondeterministic()
    return df.withColumn(name, once(F.col(vec).cast("array<double>")))


def fit_domain(train: DataFrame, vec: str, method: str = "leverage") -> Domain:
    return fit_leverage(train, vec) if method == "leverage" else fit_distance(train, vec)


def refit_if_needed(domain: Domain | None, train: DataFrame, vec: str, width: int, method: str = "leverage") -> Domain:
    """The saved domain when its width fits, else a new one."""
    return domain if domain is not None and domain.n_features == width else fit_domain(train, vec, method)


def assess(df: DataFrame, vec: str, domain: Domain) -> DataFrame:
    """Rows with h, within (h <= threshold)."""
    return add_domain_value(df, vec, domain).withColumn("within", F.col("h") <= F.lit(domain.threshold))


def assess_summary(assessed: DataFrame, domain: Domain) -> DataFrame:
    """One row: method, threshold, coverage, mean, max, outlier count and the sizes."""
    return assessed.agg(
        F.avg(F.col("within").cast("double")).alias("coverage"),
        F.avg("h").alias("mean_value"),
        F.max("h").alias("max_value"),
        F.count_if(~F.col("within")).alias("n_outliers"),
        F.count(F.lit(1)).alias("test_samples"),
    ).select(
        F.lit(domain.method).alias("method"),
        F.lit(domain.threshold).alias("threshold"),
        "*",
        F.lit(domain.n_train).alias("training_samples"),
        F.lit(domain.n_features).alias("n_features"),
    )


def outliers(assessed: DataFrame, key: str) -> DataFrame:
    return assessed.where(~F.col("within")).select(key, "h")


def reliability(value: Column, threshold: float | Column) -> Column:
    """1 at the centre, 0 from twice the threshold on."""
    cut = F.lit(threshold) if isinstance(threshold, float) else threshold
    return F.lit(1.0) - F.least(F.greatest(value / (cut * F.lit(2.0)), F.lit(0.0)), F.lit(1.0))


def domain_flag(within: Column | None) -> Column:
    """struct(in_domain, confidence); without a domain model every row is inside with full confidence."""
    inside = F.lit(True) if within is None else F.coalesce(within, F.lit(True))
    return F.struct(
        inside.alias("in_domain"),
        F.when(inside, F.lit(IN_DOMAIN_CONFIDENCE)).otherwise(F.lit(OUT_OF_DOMAIN_CONFIDENCE)).alias("confidence"),
    )


def save_rows(domain: Domain, spark) -> DataFrame:
    """State table of a domain: one row per feature."""
    rows = [
        (i, list(domain.whitening[i]) if domain.whitening else None, domain.centre[i] if domain.centre else None)
        for i in range(domain.n_features)
    ]
    return spark.createDataFrame(rows, "idx int, whitening array<double>, centre double").withColumns(
        {
            "method": F.lit(domain.method),
            "threshold": F.lit(domain.threshold),
            "n_train": F.lit(domain.n_train),
        }
    )


def from_rows(state: DataFrame) -> Domain:
    rows = state.orderBy("idx").collect()
    head = rows[0]
    return Domain(
        head.method,
        head.threshold,
        head.n_train,
        len(rows),
        tuple(tuple(r.whitening) for r in rows) if head.whitening is not None else None,
        tuple(r.centre for r in rows) if head.centre is not None else None,
    )
