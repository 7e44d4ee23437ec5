"""Kernel machines on landmarks: hinge loss for classes, a tube without loss for numbers.

The RBF kernel is replaced by its projection on a fixed number of landmark rows (Nystroem): features z with
z(a)'z(b) = k(a, L) k(L, L)^+ k(L, b), which is the kernel itself where all rows are landmarks. Landmarks are drawn
from all rows with chances that follow their ridge leverage, so rare kinds of rows are not missed. The machine is
then linear in z. Its loss is minimised by Newton steps: tasks sum loss, gradient and curvature, and the driver
holds one landmarks x landmarks matrix.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml.base import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCol, HasLabelCol, HasOutputCol, HasSeed, HasWeightCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.session import stage_table

#: Half width of the tube, as in common support vector regression.
TUBE = 0.1
#: Width of the rounded corner of a loss: the last one is this share of the tube, or of the margin of 1.
CORNER_OF_TUBE, CORNER_OF_MARGIN = 0.1, 0.01
#: Curvature outside of a corner fades with this power of the distance, so steps foresee corners that they cross.
FADE = 1.5
STEPS, LANES, BATCH = 12, 16, 4096


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |a - b|^2) for all rows of both matrices."""
    d = (x * x).sum(1)[:, None] - 2 * x @ landmarks.T + (landmarks * landmarks).sum(1)[None, :]
    return np.exp(-gamma * np.maximum(d, 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def drawn_rows(rows: DataFrame, many: int, chance: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """``many`` different vectors of (h long, v array), drawn without replacement by their chances.

    A row's place is -log(u) / chance with u from the hash of its vector; the smallest places win, so a draw
    depends on the values alone and copies count once. A task hands on at most ``many`` vectors.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[float, int, np.ndarray]] = []
        inside: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x, h = _matrix(part.column(1)), part.column(0).to_numpy(zero_copy_only=False)
                u = (h.astype(np.uint64) >> np.uint64(11)).astype(float) * 2.0**-53
                place = -np.log(u + 2.0**-54) / np.maximum(chance(x), 1e-9)
                limit = -held[0][0] if len(held) == many else np.inf
                for i in np.flatnonzero(place <= limit):
                    mark = int(h[i])
                    if mark in inside:
                        continue
                    entry = (-float(place[i]), mark, x[i].copy())  # a view would hold on to the whole batch
                    if len(held) < many:
                        heapq.heappush(held, entry)
                    elif entry[:2] > held[0][:2]:
                        inside.discard(heapq.heapreplace(held, entry)[1])
                    else:
                        continue
                    inside.add(mark)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-e[0] for e in held], pa.float64()), pa.array([e[1] for e in held], pa.int64()), pa.array([e[2].tolist() for e in held], pa.list_(pa.float64()))],
            names=["place", "h", "v"],
        )

    parts = rows.select("h", "v").mapInArrow(best, "place double, h long, v array<double>")
    kept = parts.dropDuplicates(["h"]).orderBy("place", "h").limit(many).collect()  # a fixed number of rows
    return np.array([r.v for r in kept], float)


def landmark_rows(df: DataFrame, vec: str, many: int, gamma: float, ridge: float, seed: int) -> np.ndarray:
    """Landmarks by approximate ridge leverage; all different rows where there are at most ``many``.

    An even draw is the pilot. A row's leverage is what the pilot leaves unexplained of it:
    k(x, x) - k(x, S) (K_SS + ridge q I)^-1 k(S, x), with q the share of rows in the pilot.
    """
    v = F.col(vec)
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vectors = df.select(v.cast("array<double>").alias(vec)).where(usable)
    rows, again = (vectors.select(F.xxhash64(F.lit(s), v).alias("h"), v.alias("v")) for s in (seed, seed + 1))
    pilot = drawn_rows(rows, many, lambda x: np.ones(len(x)))
    if len(pilot) < many:
        return pilot
    share = min(1.0, len(pilot) / rows.count())
    inverse = np.linalg.inv(rbf(pilot, pilot, gamma) + ridge * share * np.eye(len(pilot)))

    def leverage(x: np.ndarray) -> np.ndarray:
        k = rbf(x, pilot, gamma)
        return 1.0 - ((k @ inverse) * k).sum(axis=1)

    return drawn_rows(again, many, leverage)


class _Kernel(HasInputCol, HasOutputCol, HasSeed):
    components = Param(Params._dummy(), "components", "number of landmarks", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    ridge = Param(Params._dummy(), "ridge", "ridge of the leverage", TypeConverters.toFloat)


class LandmarkKernel(Estimator, _Kernel, DefaultParamsReadable, DefaultParamsWritable):
    """Landmark features of an RBF kernel. Rows without a finite vector are no landmarks; no row at all is an error."""

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seed=42, components=256, gamma=1.0, ridge=0.1):
        super().__init__()
        self._setDefault(seed=42, components=256, gamma=1.0, ridge=0.1)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> LandmarkModel:
        gamma = self.getOrDefault(self.gamma)
        raw = F.col(self.getInputCol())
        vectors = dataset.where(raw.isNotNull()).select(vector_to_array(raw).alias("v"))
        landmarks = landmark_rows(vectors, "v", self.getOrDefault(self.components), gamma, self.getOrDefault(self.ridge), self.getSeed())
        if not len(landmarks):
            raise ValueError("a kernel needs a row with a finite vector")
        sizes, directions = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
        real = sizes > len(sizes) * 1e-12 * sizes.max()
        whitening = directions[:, real] / np.sqrt(sizes[real])
        model = LandmarkModel()
        return self._copyValues(model)._set(landmarks=landmarks.ravel().tolist(), whitening=whitening.ravel().tolist(), rows=len(landmarks))


class LandmarkModel(Model, _Kernel, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted landmark features; a null vector, or one with a value that is not finite, has null features."""

    landmarks = Param(Params._dummy(), "landmarks", "landmark rows, one after the other", TypeConverters.toListFloat)
    whitening = Param(Params._dummy(), "whitening", "inverse root of the landmarks' kernel, by rows", TypeConverters.toListFloat)
    rows = Param(Params._dummy(), "rows", "number of landmarks found", TypeConverters.toInt)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        n, gamma = self.getOrDefault(self.rows), self.getOrDefault(self.gamma)
        landmarks = np.array(self.getOrDefault(self.landmarks)).reshape(n, -1)
        whitening = np.array(self.getOrDefault(self.whitening)).reshape(n, -1)

        @F.pandas_udf("array<double>")
        def expand(v: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), dtype=object)
            there = np.array([i for i, x in enumerate(v) if x is not None and np.isfinite(x).all()], int)
            for at in range(0, len(there), BATCH):
                some = there[at : at + BATCH]
                z = rbf(np.stack(v.iloc[some].to_numpy()).astype(float), landmarks, gamma) @ whitening
                for place, row in zip(some, z):
                    out.iat[place] = row
            return out

        raw = F.col(self.getInputCol())
        z = expand(F.when(raw.isNotNull(), vector_to_array(raw)))
        out = dataset.withColumn(self.getOutputCol(), z)
        return out.withColumn(self.getOutputCol(), F.when(F.col(self.getOutputCol()).isNotNull(), array_to_vector(self.getOutputCol())))


def _sums(z: np.ndarray, y: np.ndarray, weight: np.ndarray, at: np.ndarray, step: np.ndarray, tube: float | None, corner: float) -> np.ndarray:
    """Losses at ``at + step`` and shorter steps, then the gradient and both curvatures at ``at + step``."""

    def parts(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if tube is None:
            return 1.0 - y * f, y
        return np.abs(y - f) - tube, np.sign(y - f)

    def loss(u: np.ndarray) -> float:
        inside = np.clip(u, 0.0, corner)
        return float((weight * (inside * inside / (2 * corner) + np.maximum(u - corner, 0.0))).sum())

    here, ahead = z @ at, z @ step
    u, side = parts(here + ahead)
    pull = -side * weight * np.clip(u / corner, 0.0, 1.0)
    away = np.maximum(np.abs(2 * u / corner - 1.0), 1.0)
    faded = (z * (weight * away**-FADE / corner)[:, None]).T @ z
    inside = (u > 0) & (u < corner)
    true = (z[inside] * (weight[inside] / corner)[:, None]).T @ z[inside]
    shorter = [loss(parts(here + ahead * 0.5**i)[0]) for i in range(1, STEPS)]
    return np.concatenate([[loss(u)], shorter, z.T @ pull, faded.ravel(), true.ravel()])


def _passed(rows: DataFrame, at: np.ndarray, step: np.ndarray, tube: float | None, corner: float) -> np.ndarray:
    """The sums of all rows: one vector per task, added up in lanes, a few of which reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                part = batch.slice(start, BATCH)
                z = _matrix(part.column(0))
                y, weight = (part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                found = _sums(np.hstack([z, np.ones((len(z), 1))]), y, weight, at, step, tube, corner)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                m = np.frombuffer(blob.as_buffer(), np.float64)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    lanes = rows.mapInArrow(run, "m binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    found = lanes.repartition("lane").select("m").mapInArrow(add, "m binary").collect()  # at most one per lane
    return np.sum([np.frombuffer(r.m, np.float64) for r in found], axis=0)


def minimise(rows: DataFrame, width: int, cost: float, tube: float | None, start: float, spread: float, most: int = 100) -> np.ndarray:
    """Weights, then the intercept, of |w|^2 / 2 + cost x loss over (z, y, weight).

    The corner of the loss is rounded by a parabola that narrows fivefold from the spread of the targets to its last
    width, and every width is solved by Newton steps from the solution before, the last one closely. Of a step and its
    halvings, whose losses come from one pass, the best is taken. Steps use the faded curvature, and the true one where
    that gains little.
    """
    last = CORNER_OF_TUBE * tube if tube else CORNER_OF_MARGIN
    corners = [last]
    while corners[-1] * 5 < spread:
        corners.append(corners[-1] * 5)
    at = np.append(np.zeros(width), start)
    bounded = np.append(np.ones(width), 0.0)
    sizes = 0.5 ** np.arange(STEPS)
    whole = lambda place, loss: 0.5 * float((bounded * place * place).sum()) + cost * loss
    for corner in reversed(corners):
        here, passes, true = _passed(rows, at, np.zeros(width + 1), tube, corner), 1, False
        while passes < most:
            slope = bounded * at + cost * here[STEPS : STEPS + width + 1]
            faded, sharp = (np.diag(bounded) + cost * c for c in here[STEPS + width + 1 :].reshape(2, width + 1, width + 1))
            sharp[-1, -1] += cost if sharp[-1, -1] == 0 else 0.0
            steps = [-np.linalg.solve(bend + 1e-8 * cost * np.diag(1 - bounded), slope) for bend in (faded, sharp)]
            now, close = whole(at, here[0]), corner == last
            if -slope @ steps[close] <= (1e-6 if close else 1e-3) * (1.0 + abs(now)):
                break
            step = steps[true]
            ahead, passes = _passed(rows, at, step, tube, corner), passes + 1
            values = np.array([whole(at + t * step, loss) for t, loss in zip(sizes, ahead[:STEPS])])
            best = int(values.argmin())
            gain = now - values[best]
            if gain <= 0:
                if not true:
                    break
                true = False
                continue
            if now - values[0] > 0.8 * gain:
                best = 0  # nearly as good, and its gradient is there
            true = close and bool(best <= 1 if true else gain < 1e-3 * abs(now))
            at = at + sizes[best] * step
            if best:
                ahead, passes = _passed(rows, at, np.zeros(width + 1), tube, corner), passes + 1
            here = ahead
    return at


class _Margin(HasFeaturesCol, HasLabelCol, HasWeightCol, HasOutputCol):
    tube = Param(Params._dummy(), "tube", "half width of the tube without loss; absent for classes", TypeConverters.toFloat)
    cost = Param(Params._dummy(), "cost", "weight of the loss", TypeConverters.toFloat)


class MarginMachine(Estimator, _Margin, DefaultParamsReadable, DefaultParamsWritable):
    """Linear machine with |w|^2 / 2 + cost x sum of losses: hinge of labels 0 and 1, or with ``tube`` the distance of
    the residual from the tube. Rows with a null label, weight or vector take no part; none left is an error."""

    @keyword_only
    def __init__(self, *, featuresCol=None, labelCol=None, weightCol=None, outputCol=None, tube=None, cost=1.0):
        super().__init__()
        self._setDefault(cost=1.0, outputCol="margin")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> MarginModel:
        tube = self.getOrDefault(self.tube) if self.isDefined(self.tube) else None
        label = F.col(self.getLabelCol()).cast("double")
        weight = F.col(self.getWeightCol()).cast("double") if self.isDefined(self.weightCol) else F.lit(1.0)
        target = label if tube is not None else F.when(label > 0, 1.0).when(label.isNotNull(), -1.0)
        raw = F.col(self.getFeaturesCol())
        z = F.when(raw.isNotNull(), vector_to_array(raw))
        usable = dataset.select(z.alias("z"), target.alias("y"), weight.alias("weight")).where("z IS NOT NULL AND y IS NOT NULL AND weight IS NOT NULL")
        rows = stage_table(usable, "margin")
        facts = rows.agg(F.max(F.size("z")).alias("width"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd")).first()
        if facts.width is None:
            raise ValueError("a machine needs a row with vector, label and weight")
        start, spread = (0.0, 1.0) if tube is None else (facts.mean, facts.sd)
        found = minimise(rows, facts.width, self.getOrDefault(self.cost), tube, start, spread)
        model = MarginModel()
        return self._copyValues(model)._set(coefficients_=found[:-1].tolist(), intercept=float(found[-1]))


class MarginModel(Model, _Margin, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted machine: the value as a number with a tube, as a vector of one entry for classes."""

    coefficients_ = Param(Params._dummy(), "coefficients_", "weights", TypeConverters.toListFloat)
    intercept = Param(Params._dummy(), "intercept", "intercept", TypeConverters.toFloat)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        raw = F.col(self.getFeaturesCol())
        terms = F.zip_with(F.when(raw.isNotNull(), vector_to_array(raw)), F.lit(self.getOrDefault(self.coefficients_)), lambda x, w: x * w)
        value = F.aggregate(terms, F.lit(self.getOrDefault(self.intercept)), lambda a, x: a + x)
        return dataset.withColumn(self.getOutputCol(), value if self.isDefined(self.tube) else F.when(value.isNotNull(), array_to_vector(F.array(value))))
