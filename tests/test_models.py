import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from assayloom.operators import domain as D
from assayloom.operators import features as X
from assayloom.operators import models as M
from assayloom.operators import scoring as Z
from assayloom.operators.splits import repeated_kfold, repeated_stratified_kfold, stratified_split
from assayloom.sources.state import load_model, save_model

SETTINGS = {"forest": {"numTrees": 10, "maxDepth": 4}, "boosted": {"maxIter": 5, "maxDepth": 3, "stepSize": 0.2, "subsamplingRate": 0.9}, "kernel": {"C": 10.0}}


@pytest.fixture(scope="module")
def ring(spark):
    """Inner disc against outer ring: linear models fail, kernel and trees do not."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    rows = [(i, v.tolist(), float(np.hypot(*v) > 1.2)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "key long, features array<double>, y double")


def test_all_classifiers_learn_the_ring(ring):
    table = stratified_split(ring, "key", "y")
    fitted, preds = M.train_all(table, "classification", SETTINGS, components=128)
    got = {r.model: r.auc for r in M.all_metrics(preds, "classification", ["model"]).collect()}
    assert set(got) == {"RandomForest", "BoostedTrees", "LeafwiseTrees", "KernelSVC"} and min(got.values()) > 0.8
    assert preds.where("model = 'KernelSVC'").count() == table.where("split = 'test'").count()
    assert M.importance_topk(ring.sparkSession, fitted["RandomForest"], ["a", "b"]).count() == 2
    assert M.importance_topk(ring.sparkSession, fitted["KernelSVC"], ["a", "b"]).count() == 0


def test_kernel_features_approximate_the_kernel(spark):
    x = np.random.default_rng(1).normal(size=(20, 3))
    df = M.with_vector(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, features array<double>"))
    out = M.RandomFourier(inputCol="x", outputCol="z", components=8192, gamma=0.3, seed=1).transform(df)
    z = np.array([r.z.toArray() for r in out.orderBy("key").collect()])
    want = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(z @ z.T - want).max() < 0.06


def test_models_reload(ring, tmp_path):
    table = stratified_split(ring, "key", "y")
    fitted, _ = M.train_all(table, "classification", SETTINGS, ["KernelSVC"], components=16)
    path = save_model(fitted["KernelSVC"], str(tmp_path / "m"))
    rows = M.with_vector(ring)
    one = [r.prediction for r in fitted["KernelSVC"].transform(rows).orderBy("key").collect()]
    assert isinstance(load_model(path), PipelineModel)
    assert [r.prediction for r in load_model(path).transform(rows).orderBy("key").collect()] == one
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"))


def test_regression_cross_validation_q2(spark):
    x = np.random.default_rng(2).normal(size=(120, 2))
    rows = [(i, v.tolist(), float(v[0] * 2 + v[1])) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "key long, features array<double>, y double")
    folds = repeated_kfold(table.select("key"), "key", 3, 1)
    preds, means = M.cross_validate(table, folds, "regression", 3, 1, SETTINGS, ["KernelSVR"], components=128)
    assert preds.count() == 120
    got = {r.fold: r for r in M.cv_metrics(preds, means, "regression").collect()}
    local = preds.toPandas()
    for fold, r in got.items():
        val, rest = local[local.fold == fold], local[local.fold != fold]
        res = ((val.y - val.prediction) ** 2).sum()
        assert abs(r.q2 - (1 - res / ((val.y - rest.y.mean()) ** 2).sum())) < 1e-9
        assert abs(r.r2 - (1 - res / ((val.y - val.y.mean()) ** 2).sum())) < 1e-9 and r.r2 > 0.5


def test_tuning_draws_stay_in_range_and_best_is_refitted(ring):
    for family, ranges in M.TUNING.items():
        for draw in M.draw_settings(family, 50):
            for name, (kind, *arg) in ranges.items():
                assert draw[name] in arg if kind == "choice" else arg[0] <= draw[name] <= arg[1]
    assert M.draw_settings("forest", 3) == M.draw_settings("forest", 3)
    folds = repeated_stratified_kfold(ring.select("key", "y"), "key", "y", 2, 1)
    small = {"forest": {"numTrees": 5, "maxDepth": 4}}
    trials, best = M.tune(ring, folds, "classification", 6, 2, ("forest",), small)
    rows = trials.collect()
    assert len(rows) == 6 and best["score"] == max(r.score for r in rows if r.folds == 2)
    assert any("'class_weight', 'balanced'" in r.params for r in rows) and any("'class_weight', 'none'" in r.params for r in rows)
    _, preds = M.refit_best(stratified_split(ring, "key", "y"), "classification", best)
    assert {r.model for r in preds.select("model").distinct().collect()} == {"forest_optimized"}


def test_comparison_uses_the_same_folds(ring):
    aligned = ring.select("key", F.col("features").alias("x2d"), F.slice("features", 1, 1).alias("x3d"), "y")
    folds = repeated_stratified_kfold(ring.select("key", "y"), "key", "y", 2, 1)
    preds = M.compare_representations(aligned, folds, "classification", 2, 1, SETTINGS, ["RandomForest"])
    keys = preds.groupBy("representation").agg(F.sum(F.xxhash64("key", "fold").cast("decimal(38,0)")).alias("h"), F.count("*").alias("n")).collect()
    assert len({r.h for r in keys}) == 1 and {r.n for r in keys} == {300}
    assert M.fold_scores(preds, "classification").count() == 6


def test_scoring_keeps_bad_rows(ring, spark):
    state = X.fit_standard(ring, "features")
    scaled = X.scale(ring, "features", state)
    model = M.model_set("classification", SETTINGS)["RandomForest"].fit(M.with_vector(scaled))
    em = Z.EndpointModel("ames", "classification", "forest", model, state, D.fit_domain(scaled, "features"))
    rows = spark.createDataFrame([("CCO", [0.0, 0.0]), ("invalid", None), ("far", [50.0, 50.0]), ("gap", [1.0, None])], "key string, features array<double>")
    got = {r.key: r for r in Z.score_all(rows, "key", "features", [em]).collect()}
    assert [got[k].success for k in ("CCO", "invalid", "far", "gap")] == [True, False, True, False]
    assert got["CCO"].applicability_domain.in_domain and not got["far"].applicability_domain.in_domain
    assert got["far"].applicability_domain.confidence == 0.5 and got["CCO"].label == "Non-mutagenic"
    assert got["invalid"].error == "Invalid input" and got["invalid"].probability is None


def test_linear_explanation_adds_up(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, -1.0])], "key string, v array<double>")
    got = {r.key: r for r in Z.linear_explanation(df, "key", "v", [2.0, -1.0], [1.0, 0.0], ["MolWt", "TPSA"], intercept=0.5).collect()}
    assert got["b"].score == pytest.approx(0.5 + 2 * 3 + 1) and got["b"].base_value == 2.5
    assert [f.feature for f in got["b"].top_features] == ["MolWt", "TPSA"] and got["a"].top_features[0].contribution == "decreases"
