"""Training state of every fold of a repeated cross-validation from one aggregation.

Count, means and variances of each (repeat, fold) are collected once; the training rows of a fold are all other folds
of its repeat, so their state is the merge of those folds' moments. Merging is as exact as a pass over the rows, where
taking a fold's sums of squares from the total would lose digits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Moments:
    """Rows, and per feature mean and sum of squared differences from it; sum and count of the target."""

    n: int
    mean: np.ndarray
    m2: np.ndarray
    y_sum: float
    y_n: int

    def merge(self, other: Moments) -> Moments:
        n = self.n + other.n
        step = other.mean - self.mean
        return Moments(
            n, self.mean + step * (other.n / n), self.m2 + other.m2 + step * step * (self.n * other.n / n),
            self.y_sum + other.y_sum, self.y_n + other.y_n,
        )

    @property
    def scale(self) -> np.ndarray:
        deviation = np.sqrt(self.m2 / self.n)
        return np.where(deviation > 0, deviation, 1.0)

    @property
    def y_mean(self) -> float | None:
        return self.y_sum / self.y_n if self.y_n else None

    @property
    def scaled_gamma(self) -> float:
        """1 / (features x variance over all entries) of rows scaled by this state: constant features are all zero."""
        varying = int((self.m2 > 0).sum())
        return 1.0 / varying if varying else 1.0

    def state(self, spark: SparkSession) -> DataFrame:
        """(idx, centre, scale), as the fitted scalers have it."""
        rows = [(i, float(c), float(s)) for i, (c, s) in enumerate(zip(self.mean, self.scale))]
        return spark.createDataFrame(rows, "idx int, centre double, scale double")


def fold_moments(rows: DataFrame, places: Sequence[str], vec: str = "features", y: str = "y") -> dict[tuple[int, int], Moments]:
    """Moments by (repeat, fold); ``places`` are the fold columns of the repeats.

    Vectors have equal widths and no gaps, as the models need; a null target counts as a row but not in its mean,
    and rows without a fold are left out. One row per repeat and fold reaches the driver.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(p).alias("fold")) for r, p in enumerate(places)])).alias("at")
    long = rows.select(array_to_vector(F.col(vec)).alias("x"), F.col(y).alias("y"), each).where("at.fold IS NOT NULL")
    got = long.groupBy("at.repeat", "at.fold").agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("x")).alias("s"), F.sum("y").alias("y_sum"), F.count("y").alias("y_n")
    )
    return {
        (r.repeat, r.fold): Moments(r.s["count"], r.s["mean"].toArray(), r.s["variance"].toArray() * (r.s["count"] - 1), r.y_sum or 0.0, r.y_n)
        for r in got.collect()
    }


def fold_classes(rows: DataFrame, places: Sequence[str], y: str = "y") -> dict[tuple[int, int], dict[float, int]]:
    """Labelled rows by (repeat, fold) and class, from one aggregation."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(p).alias("fold")) for r, p in enumerate(places)])).alias("at")
    long = rows.select(F.col(y).alias("y"), each).where("at.fold IS NOT NULL AND y IS NOT NULL")
    out: dict[tuple[int, int], dict[float, int]] = {}
    for r in long.groupBy("at.repeat", "at.fold", "y").count().collect():
        out.setdefault((r.repeat, r.fold), {})[r.y] = r["count"]
    return out


def train_weight(classes: dict[tuple[int, int], dict[float, int]], repeat: int, fold: int, y: str = "y") -> Column:
    """n / (classes x n of the class) over the training rows of a fold; null for a class that they do not have."""
    total: Counter[float] = Counter()
    for (r, f), counts in classes.items():
        if r == repeat and f != fold:
            total.update(counts)
    weight = F.lit(None).cast("double")
    for label, n in sorted(total.items()):
        weight = F.when(F.col(y) == label, total.total() / (len(total) * n)).otherwise(weight)
    return weight


def train_moments(moments: dict[tuple[int, int], Moments], repeat: int, fold: int) -> Moments:
    """Moments of the training rows of a fold: those of all other folds of its repeat."""
    others = [m for (r, f), m in sorted(moments.items()) if r == repeat and f != fold]
    if not others:
        raise ValueError(f"fold {fold} of repeat {repeat} has no training rows")
    out = others[0]
    for m in others[1:]:
        out = out.merge(m)
    return out
