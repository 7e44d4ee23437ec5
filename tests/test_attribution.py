"""Tree attributions against walks by hand and fitted models; pair-wise correlations against numpy; exact keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from assayloom.operators import attribution as A
from assayloom.operators import features as X
from assayloom.operators import lookup as L
from assayloom.operators import models as M
from assayloom.operators.correlation import pairwise_correlations
from assayloom.operators.scoring import EndpointModel

BIG = 2**53 + 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4))
    return spark.createDataFrame([(i, v.tolist(), float(v[0] * v[1] > 0), float(v[0] + v[2] ** 2)) for i, v in enumerate(x)], "key long, features array<double>, y double, z double").cache()


def test_attribution_by_hand(spark):
    nodes = [(7, 0, 1, 2, 1, 0.5, 0.4, 2.0), (7, 1, -1, -1, -1, None, 0.1, 2.0), (7, 2, 3, 4, 0, 0.0, 0.6, 2.0), (7, 3, -1, -1, -1, None, 0.5, 2.0), (7, 4, -1, -1, -1, None, 1.0, 2.0), (9, 0, -1, -1, -1, None, 3.0, 1.0)]
    trees = A.flat_trees(spark.createDataFrame(nodes, A.NODES))
    df = spark.createDataFrame([("a", [0.0, 0.5]), ("b", [0.0, 0.6]), ("c", [0.1, 0.6]), ("gap", [None, 1.0]), ("none", None)], "k string, v array<double>")
    got = {r.k: r for r in A.explain_trees(df, "v", trees).collect()}
    assert trees.base == pytest.approx(3.8)
    assert got["a"].contributions == pytest.approx([0.0, -0.6]) and got["a"].score == pytest.approx(3.2)
    assert got["b"].contributions == pytest.approx([-0.2, 0.4]) and got["c"].contributions == pytest.approx([0.8, 0.4])
    assert got["gap"].contributions is None and got["none"].contributions is None and got["none"].score is None


@pytest.mark.parametrize("make, label, own", [
    (lambda: RandomForestClassifier(numTrees=7, maxDepth=6, seed=1), "y", lambda: vector_to_array("probability")[1]),
    (lambda: RandomForestRegressor(numTrees=5, maxDepth=8, seed=1), "z", lambda: F.col("prediction")),
    (lambda: GBTRegressor(maxIter=6, maxDepth=4, seed=1), "z", lambda: F.col("prediction")),
    (lambda: GBTClassifier(maxIter=6, maxDepth=4, seed=1), "y", lambda: vector_to_array("rawPrediction")[1]),
])
def test_base_and_attributions_are_the_score(rows, make, label, own):
    model = make().setFeaturesCol("x").setLabelCol(label).fit(M.with_vector(rows))
    scored = model.transform(M.with_vector(rows)).select("key", "features", own().alias("own"))
    out = A.explain_trees(scored, "features", A.flat_trees(A.tree_nodes(model))).collect()
    assert len(out) == 200 and max(abs(r.score - r.own) for r in out) < 1e-9
    assert any(any(r.contributions) for r in out)


def test_explain_models_covers_trees_and_linear_models(rows):
    state = X.fit_standard(rows, "features")
    scaled = M.with_vector(X.scale(rows, "features", state))
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=4, seed=1).fit(scaled)
    linear = LinearRegression(featuresCol="x", labelCol="z").fit(scaled)
    models = [EndpointModel("ames", "classification", "f", forest, state), EndpointModel("herg", "regression", "l", linear, state)]
    top = A.explain_models(rows, "key", "features", models, ["MolWt", "b", "c", "d"], 2)
    assert top.count() == 800 and {r.rank for r in top.select("rank").distinct().collect()} == {1, 2}
    own = linear.transform(scaled).select("key", "prediction")
    assert top.where("endpoint = 'herg'").join(own, "key").where("abs(score - prediction) > 1e-9").count() == 0
    insights = A.endpoint_insights(top, ["key"])
    assert {r.kind for r in insights.select("kind").distinct().collect()} == {"common", "opposite"}
    svm = M.model_set("classification", {**M.BASELINE})["KernelSVC"].fit(scaled.select("x", "y"))
    with pytest.raises(TypeError):
        A.explain_models(rows, "key", "features", [EndpointModel("ames", "classification", "k", svm, state)], ["a", "b", "c", "d"])
    with pytest.raises(TypeError):
        A.tree_nodes(LogisticRegression(featuresCol="x", labelCol="y").fit(scaled))


@pytest.mark.parametrize("block", [2, 3, 256])
def test_correlations_of_features_with_gaps(spark, block):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 7)) + 1e6
    x[:, 3] = x[:, 1] * 2 + rng.normal(size=300) / 10
    x[:, 5] = 4.0
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 6] = np.nan
    data = [([None if np.isnan(v) else float(v) for v in r],) for r in x] + [(None,), ([],), ([float("inf"), float("nan")],)]
    df = spark.createDataFrame(data, "v array<double>").repartition(5)
    got = {(r.i, r.j): (r.n, r.r) for r in pairwise_correlations(df, "v", block=block).collect()}
    want = pd.DataFrame(x).corr()
    assert set(got) == {(i, j) for j in range(7) for i in range(j)}
    for (i, j), (n, r) in got.items():
        assert n == int((np.isfinite(x[:, i]) & np.isfinite(x[:, j])).sum())
        assert r is None if 5 in (i, j) or j == 6 else r == pytest.approx(want[i][j], abs=1e-8)
    assert X.correlated_places(df, "v") == {3}


def test_correlations_of_an_empty_table(spark):
    df = spark.createDataFrame([], "v array<double>")
    assert pairwise_correlations(df, "v").count() == 0 and X.correlated_places(df, "v") == set()


def test_every_row_may_have_a_gap(spark):
    rows = [([None if (i + j) % 3 == 0 else float(i * (j + 1)) for j in range(3)],) for i in range(30)]
    assert X.correlated_places(spark.createDataFrame(rows, "v array<double>"), "v") == {1, 2}


def test_keys_beyond_doubles_stay_exact(spark):
    df = spark.createDataFrame([(BIG, "a"), (None, "b"), (BIG + 2, "c")], "key long, text string").coalesce(1)
    made = X.featurize_once(df, "key", "text", lambda t: [1.0] if t != "c" else [float("nan")])
    assert {(r.key, r.failed) for r in made.collect()} == {(BIG, False), (None, False), (BIG + 2, True)}
    again = X.featurize_once(df, "key", "text", lambda t: 1 / 0, made)
    assert again.where("failed").count() == 1 and again.count() == 3
    scorer = L.python_scorer(lambda batch: [(float(len(t)), t != "b") for t in batch["text"]], "score double, success boolean")
    assert {(r.key, r.score, r.success) for r in scorer(df).collect()} == {(BIG, 1.0, True), (None, 1.0, False), (BIG + 2, 1.0, True)}
    seen = L.python_scorer(lambda batch: [(str(k),) for k in batch["key"]], "said string")
    assert str(BIG) in {r.said for r in seen(df.withColumn("odd name", F.lit(1))).collect()}


def test_flat_trees_do_not_need_an_order_and_miss_no_node(spark):
    nodes = [(4, 2, -1, -1, None, None, 0.5, 0.5), (4, 0, 1, 2, 3, 0.25, 0.75, 0.5), (9, 0, -1, -1, -1, None, 1.0, 0.5), (4, 1, -1, -1, -1, None, 1.0, 0.5)]
    t = A.flat_trees(spark.createDataFrame(nodes, A.NODES))
    assert [x.tolist() for x in (t.roots, t.weights, t.left, t.right, t.feature)] == [[0, 3], [0.5, 0.5], [1, 1, 2, 3], [2, 1, 2, 3], [3, -1, -1, -1]]
    assert t.value.tolist() == [0.75, 1.0, 0.5, 1.0] and t.threshold[0] == 0.25 and t.base == 0.875
    with pytest.raises(KeyError):
        A.flat_trees(spark.createDataFrame(nodes[1:], A.NODES))
    assert len(A.flat_trees(spark.createDataFrame([], A.NODES)).roots) == 0
