"""Fold states by merging, and the report on representations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import comparison as C
from assayloom.operators import folds as O
from assayloom.operators import models as M
from assayloom.operators.splits import repeated_kfold

SETTINGS = {
    "forest": {"numTrees": 5, "maxDepth": 4},
    "boosted": {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.9},
    "kernel": {"C": 1.0},
}


def test_training_state_of_every_fold(spark):
    rng = np.random.default_rng(1)
    x = np.c_[1e8 + rng.normal(size=90), rng.normal(size=90) * 1e-6, np.full(90, 7.3)]
    y = [None if i % 9 == 0 else float(i % 4) for i in range(90)]
    at = rng.integers(0, 4, (90, 2))
    rows = [(i, v.tolist(), y[i], int(at[i, 0]), None if i == 5 else int(at[i, 1])) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "key long, features array<double>, y double, fold_0 int, fold_1 int").repartition(7)
    moments = O.fold_moments(df, ["fold_0", "fold_1"])
    assert sorted(moments) == [(r, f) for r in range(2) for f in range(4)]
    for r, f in moments:
        chosen = [i for i in range(90) if rows[i][3 + r] is not None and rows[i][3 + r] != f]
        got = O.train_moments(moments, r, f)
        assert got.n == len(chosen) and got.y_mean == pytest.approx(np.mean([y[i] for i in chosen if y[i] is not None]))
        assert np.allclose(got.mean, x[chosen].mean(0), rtol=1e-14) and np.allclose(got.scale[:2], x[chosen].std(0)[:2], rtol=1e-6)
        assert got.scale[2] == 1.0 and got.scaled_gamma == 0.5
    with pytest.raises(ValueError):
        O.train_moments({(0, 0): moments[0, 0]}, 0, 0)
    assert O.fold_moments(df.limit(0), ["fold_0"]) == {}


def test_class_weights_of_every_fold(spark):
    y = [None, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 2.0, 1.0]
    df = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(y)], "key long, y double, fold_0 int")
    classes = O.fold_classes(df, ["fold_0"])
    for fold in range(3):
        train = df.where(F.col("fold_0") != fold)
        got = {r.key: r.weight for r in train.withColumn("weight", O.train_weight(classes, 0, fold)).collect()}
        assert got == pytest.approx({r.key: r.weight for r in M.balanced_weights(train, "y").collect()})


def test_tables_written_do_not_grow_with_the_folds(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(60, 2))
    table = spark.createDataFrame([(i, v.tolist(), float(v[0])) for i, v in enumerate(x)], "key long, features array<double>, y double")
    written = []
    stage = M.stage_table
    monkeypatch.setattr(M, "stage_table", lambda df, name: written.append(name) or stage(df, name))
    for k, repeats in ((2, 1), (2, 2)):
        written.clear()
        folds = repeated_kfold(table.select("key"), "key", k, repeats)
        preds, _ = M.cross_validate(table, folds, "regression", k, repeats, SETTINGS, ["RandomForest"])
        assert preds.count() == 60 * repeats and written == ["folds", "cv-predictions"]


def test_report_holds_out_rows_and_weighs_classes(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(200):
        y = float(i % 10 == 0)
        rows.append((i, rng.normal(1.2 * y, 1, 2).tolist(), rng.normal(0, 1, 2).tolist(), y))
    aligned = spark.createDataFrame(rows, "key long, x2d array<double>, x3d array<double>, y double")
    got = C.compare(aligned, "classification", 2, 1, settings=SETTINGS, models=["RandomForest"])
    held = {r.representation: r for r in got.holdout.collect()}
    assert set(held) == {"2D", "3D", "Hybrid"} and {r.n for r in held.values()} == {40}
    assert got.folds.count() == 3 * 4 and got.tests.count() == 2
    sets = [M.comparison_set("classification", SETTINGS, 0.5, 64, b) for b in (False, True)]
    assert [s["RandomForest"].isDefined("weightCol") for s in sets] == [False, True]
    assert not sets[1]["BoostedTrees"].isDefined("weightCol")

    fit = M.with_vector(M.balanced_weights(aligned.withColumn("features", F.col("x2d")), "y"))
    found = []
    for s in sets:
        p = M.predictions(s["RandomForest"].fit(fit), fit, "classification", ["key"])
        found.append(p.where("prediction = 1 AND y = 1").count())
    assert found[1] > found[0]
