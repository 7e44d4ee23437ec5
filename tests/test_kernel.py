"""Landmark kernels and margin machines against dense matrices: kernel values, dual bounds, landmarks of rare rows."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assayloom.operators import kernel as K
from assayloom.operators import models as M
from assayloom.sources.state import load_model, save_model


def frame(spark, x, y=None):
    y = np.zeros(len(x)) if y is None else y
    return M.with_vector(spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "key long, features array<double>, y double"))


def ordered(df, column):
    return np.array([r[0] for r in df.orderBy("key").select(column).collect()])


def test_all_rows_as_landmarks_give_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(40, 3))
    df = frame(spark, np.vstack([x, x]))
    model = K.LandmarkKernel(inputCol="x", outputCol="z", gamma=0.4, components=64).fit(df)
    assert model.getOrDefault(model.rows) == 40  # copies count once
    z = np.array([r.z.toArray() for r in model.transform(df).orderBy("key").collect()])
    assert np.abs(z[:40] @ z[:40].T - K.rbf(x, x, 0.4)).max() < 1e-6


def test_fewer_landmarks_stay_near_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    df = frame(spark, x).repartition(7)
    model = K.LandmarkKernel(inputCol="x", outputCol="z", gamma=0.2, components=60).fit(df)
    again = K.LandmarkKernel(inputCol="x", outputCol="z", gamma=0.2, components=60).fit(df.repartition(3))
    assert model.getOrDefault(model.landmarks) == again.getOrDefault(again.landmarks)
    z = np.array([r.z.toArray() for r in model.transform(df).orderBy("key").collect()])
    assert np.abs(z @ z.T - K.rbf(x, x, 0.2)).max() < 0.02


def test_rare_rows_become_landmarks(spark):
    rng = np.random.default_rng(2)
    common, rare = rng.normal(0, 0.01, (3000, 2)), np.array([[10.0, 0.0], [0.0, 10.0], [-10.0, 0.0]])
    df = spark.createDataFrame([(v.tolist(),) for v in np.vstack([common, rare])], "v array<double>")
    even = K.drawn_rows(df.select(F.xxhash64("v").alias("h"), "v"), 12, lambda x: np.ones(len(x)))
    chosen = K.landmark_rows(df, "v", 12, 1.0, 0.1, 42)
    assert len(even) == len(chosen) == 12
    assert (np.abs(even).max(1) > 5).sum() == 0 and (np.abs(chosen).max(1) > 5).sum() == 3


@pytest.mark.parametrize("seed", [3, 4])
def test_regression_closes_the_duality_gap(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-3, 3, (120, 1))
    y = np.sin(x[:, 0]) * 2 + rng.normal(0, 0.2, 120) + 7
    df, cost = frame(spark, x, y), 2.0
    model = Pipeline(stages=[
        K.LandmarkKernel(inputCol="x", outputCol="z", gamma=0.5, components=200),
        K.MarginMachine(featuresCol="z", labelCol="y", outputCol="prediction", tube=0.1, cost=cost),
    ]).fit(df)
    f = ordered(model.transform(df), "prediction")
    r = y - f
    alpha = cost * np.sign(r) * np.clip((np.abs(r) - 0.1) / (0.1 * K.CORNER_OF_TUBE), 0, 1)
    gram = K.rbf(x, x, 0.5)
    assert (alpha[np.abs(r) < 0.1] == 0).all() and abs(alpha.sum()) < 1e-3 * np.abs(alpha).sum()
    w2 = alpha @ gram @ alpha
    primal = w2 / 2 + cost * np.maximum(np.abs(r) - 0.1, 0).sum()
    dual = y @ alpha - 0.1 * np.abs(alpha).sum() - w2 / 2
    assert np.abs(gram @ alpha + (y - r - gram @ alpha).mean() - f).max() < 1e-3  # f comes from the dual weights
    assert 0 <= primal - dual < 0.02 * primal


def test_hinge_closes_the_duality_gap(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(150, 2))
    s = np.where(np.hypot(*x.T) + rng.normal(0, 0.2, 150) > 1.2, 1.0, -1.0)
    df, cost = frame(spark, x, s > 0), 3.0
    model = Pipeline(stages=[
        K.LandmarkKernel(inputCol="x", outputCol="z", gamma=0.5, components=200), K.MarginMachine(featuresCol="z", labelCol="y", cost=cost),
    ]).fit(df)
    f = np.array([r.margin[0] for r in model.transform(df).orderBy("key").collect()])
    alpha = cost * s * np.clip((1 - s * f) / K.CORNER_OF_MARGIN, 0, 1)
    w2 = alpha @ K.rbf(x, x, 0.5) @ alpha
    primal, dual = w2 / 2 + cost * np.maximum(1 - s * f, 0).sum(), np.abs(alpha).sum() - w2 / 2
    assert abs(alpha.sum()) < 1e-3 * np.abs(alpha).sum() and 0 <= primal - dual < 0.02 * primal


def test_targets_inside_the_tube_cost_nothing(spark):
    x = np.random.default_rng(6).normal(size=(50, 2))
    y = 4 + np.random.default_rng(7).uniform(-0.09, 0.09, 50)
    z = M.with_vector(frame(spark, x, y).drop("x"))
    model = K.MarginMachine(featuresCol="x", labelCol="y", outputCol="prediction", tube=0.1, cost=10.0).fit(z)
    assert np.abs(model.getOrDefault(model.coefficients_)).max() < 1e-3
    assert (np.abs(ordered(model.transform(z), "prediction") - y) <= 0.1 * (1 + K.CORNER_OF_TUBE)).all()


def test_weights_and_copies_agree(spark):
    x = np.random.default_rng(8).normal(size=(60, 2))
    y = x[:, 0] - x[:, 1] + np.random.default_rng(9).normal(0, 0.5, 60)
    once = frame(spark, x, y).withColumn("w", F.when(F.col("key") < 20, 3.0).otherwise(1.0))
    copied = once.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int"))))
    fit = lambda df, **w: K.MarginMachine(featuresCol="x", labelCol="y", outputCol="p", tube=0.1, cost=1.0, **w).fit(df)
    a, b = fit(once, weightCol="w"), fit(copied)
    assert np.allclose(a.getOrDefault(a.coefficients_), b.getOrDefault(b.coefficients_), atol=1e-4)


def test_odd_rows(spark):
    rows = [(1, [0.0, 1.0], 1.0), (2, None, 1.0), (3, [float("nan"), 1.0], None), (4, [1.0, 0.0], 0.0), (5, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "key long, features array<double>, y double")
    df = df.withColumn("x", F.when(F.col("features").isNotNull(), array_to_vector("features")))
    kernel = K.LandmarkKernel(inputCol="x", outputCol="z", gamma=1.0).fit(df)
    assert kernel.getOrDefault(kernel.rows) == 2
    out = kernel.transform(df)
    assert out.where("key = 2").first().z is None
    model = K.MarginMachine(featuresCol="z", labelCol="y", cost=10.0).fit(out)
    got = {r.key: r.margin for r in model.transform(out).collect()}
    assert got[1][0] > 0.9 and got[4][0] < -0.9 and got[5] == got[4]
    with pytest.raises(ValueError):
        K.LandmarkKernel(inputCol="x", outputCol="z").fit(df.limit(0))
    with pytest.raises(ValueError):
        K.MarginMachine(featuresCol="z", labelCol="y").fit(out.where("y IS NULL"))


def test_machines_reload(spark, tmp_path):
    x = np.random.default_rng(10).normal(size=(60, 2))
    df = frame(spark, x, x[:, 0])
    model = M.model_set("regression", components=20)["KernelSVR"].fit(df)
    again = load_model(save_model(model, str(tmp_path / "m")))
    assert isinstance(again, PipelineModel)
    assert np.array_equal(ordered(model.transform(df), "prediction"), ordered(again.transform(df), "prediction"))
