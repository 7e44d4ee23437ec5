"""Published numbers and hand-made cases for metrics, tests and reports."""

import math

import pytest
from pyspark.sql import functions as F

from assayloom.functions.tdist import two_sided_p
from assayloom.operators import metrics as M
from assayloom.operators import validation as V


def confusion(spark, tn, fp, fn, tp):
    return spark.createDataFrame([(tn, fp, fn, tp, tn + fp + fn + tp)], "tn long, fp long, fn long, tp long, n long")


@pytest.mark.parametrize("cells, want", [
    ((5, 16, 6, 276), {"accuracy": .9274, "balanced_accuracy": .6084, "precision": .9452, "recall": .9787, "f1": .9617, "mcc": .2944, "sensitivity": .9787, "specificity": .2381}),
    ((27, 0, 2, 2), {"accuracy": .9355, "balanced_accuracy": .75, "precision": 1, "recall": .5, "f1": .6667, "mcc": .6823}),
    ((0, 12, 0, 14), {"mcc": 0, "recall": 1, "specificity": 0}),
])
def test_published_confusions(spark, cells, want):
    got = M.metrics_from_confusion(confusion(spark, *cells)).first()
    assert all(abs(got[k] - v) < 5e-5 for k, v in want.items())


def test_one_class_has_no_two_by_two(spark):
    got = M.metrics_from_confusion(confusion(spark, 0, 0, 0, 5)).first()
    assert got.sensitivity is None and got.specificity is None and got.accuracy == 1 and got.balanced_accuracy == 1


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(.9, 1), (.5, 1), (.5, 0), (.5, 0), (.1, 0)], "s double, y int")
    assert abs(M.average_precision(df, "s", "y").first()[0] - .75) < 1e-12
    assert abs(M.roc_auc(df, "s", "y").first()[0] - .8333333333) < 1e-9
    assert M.roc_auc(df.where("y = 1"), "s", "y").first()[0] == 0.0
    constant = df.withColumn("s", F.lit(1.0))
    assert M.roc_auc(constant, "s", "y").first()[0] == .5


def test_regression_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double")
    got = M.regression_metrics(df, "y", "p").first()
    assert got.r2 is None and got.mse == .5 and got.n == 2
    same = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert M.ccc_sample(same, "y", "p").first().ccc == 1.0
    assert M.ccc_sample(same.limit(1), "y", "p").first().ccc is None
    apart = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "y double, p double")
    assert M.ccc_sample(apart, "y", "p").first().ccc == 0.0


def test_small_fold_summary(spark):
    values = [.6281997855, .5594023503, .5715627997, .5721674977, .5521559347]
    df = spark.createDataFrame([("GNN", v) for v in values], "model string, value double")
    got = V.cv_summary(df, ["model"], ddof=1).first()
    assert abs(got["mean"] - .576698) < 1e-6 and abs(got.sd - .030003) < 1e-6 and got.mean_sd == "0.5767 +/- 0.0300"


@pytest.mark.parametrize("t, dof, p", [
    (115.313, 14, 2.98e-22), (0.798, 14, 0.438), (56.288, 14, 6.69e-18), (2.389, 14, 0.0315), (65.044, 14, 8.91e-19), (3.415, 14, 0.00419),
    (53.416, 14, 1.39e-17), (0.979, 14, 0.344), (86.984, 14, 1.54e-20), (-2.511, 14, 0.0249), (69.645, 14, 3.43e-19), (1.018, 14, 0.326),
])
def test_published_p_values(spark, t, dof, p):
    got = spark.range(1).select(two_sided_p(F.lit(t), F.lit(dof)).alias("p")).first().p
    assert abs(got - p) / p < 2e-2 if p < 1e-10 else abs(got - p) / p < 5e-3


@pytest.mark.parametrize("dof", [1, 2, 3, 5, 30])
def test_t_closed_forms(spark, dof):
    """Against the finite series of the t distribution for integer degrees of freedom."""
    for t in (0.0, 0.1, 1.0, 2.5, 8.0):
        th = math.atan(t / math.sqrt(dof))
        c2, a = math.cos(th) ** 2, 0.0
        if dof % 2:
            term = math.cos(th)
            for k in range((dof - 1) // 2):
                a += term
                term *= c2 * (2 * k + 2) / (2 * k + 3)
            a = 2 / math.pi * (th + math.sin(th) * a)
        else:
            term = 1.0
            for k in range(dof // 2):
                a += term
                term *= c2 * (2 * k + 1) / (2 * k + 2)
            a *= math.sin(th)
        got = spark.range(1).select(two_sided_p(F.lit(t), F.lit(dof)).alias("p")).first().p
        assert abs(got - (1 - a)) < 1e-12


def test_target_checks(spark):
    rows = [("ames", "m", "accuracy", .8065), ("ames", "m", "sensitivity", .5), ("ames", "m", "specificity", .8519), ("herg", "r", "rmse", .6), ("none", "x", "r2", 1.0)]
    long = spark.createDataFrame(rows, "endpoint string, model string, metric string, value double")
    targets = V.target_table(spark)
    met = {(r.model, r.metric): r.met for r in V.check_targets(long, targets, ["model"]).collect()}
    assert met == {("m", "accuracy"): True, ("m", "sensitivity"): False, ("m", "specificity"): True, ("r", "rmse"): True}
    every = {r.model: r["all"] for r in V.all_targets_met(long, targets, ["model"]).collect()}
    assert every == {"m": False, "r": True, "x": False}


def test_best_model_tie_goes_to_first(spark):
    df = spark.createDataFrame([("e", "b", 0.5, 1), ("e", "a", 0.5, 0), ("e", "c", 0.4, 2)], "endpoint string, model string, f1 double, pos int")
    assert V.best_by(df, "f1", ["endpoint"], "pos").first().best_model == "a"
    files = spark.createDataFrame([("e", "svc_optimized"), ("e", "xgboost_baseline"), ("e", "randomforest_optimized")], "endpoint string, artifact string")
    assert V.best_model(files, ["endpoint"]).first().best_model == "randomforest_optimized"
