"""Forests that stay in tasks: against Spark's trees, at every size of a node, and against walks through their nodes."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from assayloom.operators import attribution as A
from assayloom.operators import features as X
from assayloom.operators import forest as G
from assayloom.operators import models as M
from assayloom.operators.metrics import roc_auc
from assayloom.operators.scoring import EndpointModel
from assayloom.sources.state import load_model, save_model

ALL = {"numTrees": 1, "featureSubsetStrategy": "all", "bootstrap": False}


def table(spark, n, seed, whole=False, weight=False):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 6)).astype(float) if whole else rng.normal(size=(n, 6))
    y = (x[:, 0] * x[:, 1] + rng.normal(size=n) * x[:, 2].std() / 2 > np.median(x[:, 0] * x[:, 1])).astype(float)
    w = rng.integers(1, 4, n).astype(float) if weight else np.ones(n)
    rows = [(i, v.tolist(), float(a), float(b)) for i, (v, a, b) in enumerate(zip(x, y, w))]
    return M.with_vector(spark.createDataFrame(rows, "key long, features array<double>, y double, weight double").repartition(3)).cache()


def answers(model, df):
    return {r.key: (r.p, r.prediction) for r in model.transform(df).select("key", vector_to_array("probability")[1].alias("p"), "prediction").collect()}


def same(a, b):
    return a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-9 and a[k][1] == b[k][1] for k in a)


@pytest.mark.parametrize("depth, weight", [(5, None), (4, "weight")])
@pytest.mark.parametrize("node_rows", [100_000, 90])
def test_one_tree_is_that_of_spark_wherever_its_nodes_are_split(spark, depth, weight, node_rows):
    df = table(spark, 700, 1, whole=True, weight=bool(weight))
    more = {"weightCol": weight} if weight else {}
    own = G.TaskForest(maxDepth=depth, node_rows=node_rows, **ALL, **more).fit(df)
    want = DecisionTreeClassifier(featuresCol="x", labelCol="y", maxDepth=depth, **more).fit(df)
    assert same(answers(own, df), answers(want, df))
    assert own.nodes().count() == want.numNodes
    assert np.allclose(own.featureImportances.toArray(), want.featureImportances.toArray())


def test_deep_trees_do_not_depend_on_where_their_nodes_are_split(spark):
    df = table(spark, 900, 2)
    got = [answers(G.TaskForest(maxDepth=20, node_rows=n, minInstancesPerNode=least, **ALL).fit(df), df) for least in (1, 7) for n in (100_000, 60)]
    assert same(got[0], got[1]) and same(got[2], got[3]) and not same(got[0], got[2])


def test_a_forest_learns_as_well_as_that_of_spark_and_is_the_same_again(spark):
    fit, rest = table(spark, 1500, 3), table(spark, 1500, 4)
    options = {"featuresCol": "x", "labelCol": "y", "numTrees": 40, "maxDepth": 12, "seed": 5}
    models = {"tasks": G.TaskForest(**options), "split": G.TaskForest(**options, node_rows=300), "spark": RandomForestClassifier(**options)}
    fitted = {name: m.fit(fit) for name, m in models.items()}
    scores = [M.predictions(m, rest, "classification", ["key"]).withColumn("model", F.lit(name)) for name, m in fitted.items()]
    auc = {r.model: r.auc for r in roc_auc(M._union(scores), "score", "y", ["model"]).collect()}
    assert min(auc["tasks"], auc["split"]) > auc["spark"] - 0.02 and auc["spark"] > 0.8
    assert same(answers(fitted["split"], rest), answers(models["split"].fit(fit), rest))
    assert fitted["tasks"].trees.count() == 40 and len({r.value for r in fitted["tasks"].trees.select("value").collect()}) == 40


def test_attributions_and_scores_are_those_of_its_nodes_in_any_block(spark, monkeypatch, tmp_path):
    df = table(spark, 600, 6)
    model = G.TaskForest(numTrees=9, maxDepth=8, node_rows=150).fit(df)
    flat = A.flat_trees(A.tree_nodes(model))
    want = {r.key: r for r in A.explain_trees(df, "features", flat).collect()}
    monkeypatch.setattr(G, "HELD_ENTRIES", 300)
    odd = df.select("key", "features").unionByName(spark.createDataFrame([(-1, None), (-2, [1.0, None, 1.0, 1.0, 1.0, 1.0])], "key long, features array<double>"))
    got = {r.key: r.c for r in model.attributions(odd, "features", "c").collect()}
    assert len(got) == 602 and got[-1] is None and got[-2] is None
    assert all(np.allclose(got[k], r.contributions, atol=1e-12) for k, r in want.items())
    assert all(abs(p - want[k].score) < 1e-9 for k, (p, _) in answers(model, df).items()) and model.base == pytest.approx(flat.base)
    again = load_model(save_model(model, str(tmp_path / "forest")))
    assert same(answers(again, df), answers(model, df))


def test_explain_models_gives_the_scores_of_a_forest_at_baseline_settings(spark):
    df = table(spark, 300, 7)
    state = X.fit_standard(df, "features")
    scaled = M.with_vector(X.scale(df, "features", state))
    forest = M.model_set("classification", M.BASELINE)["RandomForest"].fit(scaled)
    assert isinstance(forest, G.TaskForestModel) and forest.trees.count() == 300
    top = A.explain_models(df, "key", "features", [EndpointModel("ames", "classification", "f", forest, state)], list("abcdef"), 2)
    own = M.predictions(forest, scaled, "classification", ["key"])
    both = top.where("rank = 1").join(own.select("key", F.col("score").alias("own")), "key").collect()
    assert len(both) == 300 and max(abs(r.score - r.own) for r in both) < 1e-9


def test_rows_that_come_twice_odd_values_and_other_labels(spark):
    x = [([float(i % 2), float(i % 3), 5.0], float(i % 2)) for i in range(40)] * 2
    df = M.with_vector(spark.createDataFrame([(None if i % 5 else 1, *r) for i, r in enumerate(x)], "key long, features array<double>, y double"))
    model = G.TaskForest(numTrees=5).fit(df)
    out = model.transform(df).collect()
    assert len(out) == 80 and sum(r.key is None for r in out) == 64 and all(r.prediction == r.y for r in out)
    assert model.transform(df.limit(0)).count() == 0
    one_class = G.TaskForest(numTrees=3).fit(df.withColumn("y", F.lit(1.0))).transform(df)
    assert {(r.prediction, r.probability[1]) for r in one_class.collect()} == {(1.0, 1.0)}
    three = G.TaskForest(numTrees=3).fit(df.withColumn("y", F.col("y") * 2))
    assert three.numClasses == 3
    for odd in (None, -1.0, 0.5):
        with pytest.raises(ValueError):
            G.TaskForest().fit(df.withColumn("y", F.when(F.col("features")[0] == 1, odd).otherwise(0.0)))
    for odd in (float("nan"), float("inf")):
        with pytest.raises(ValueError):
            G.TaskForest().fit(M.with_vector(df.withColumn("features", F.array(F.lit(1.0), F.lit(odd)))))
        with pytest.raises(Exception, match="NaN"):
            RandomForestClassifier(featuresCol="x", labelCol="y").fit(M.with_vector(df.withColumn("features", F.array(F.lit(1.0), F.lit(odd)))))
    with pytest.raises(ValueError):
        G.TaskForest().fit(df.limit(0))
    assert G.TaskForest(numTrees=400, maxDepth=3).fit(df.limit(1)).trees.count() < 400


def test_small_forests_and_those_of_numbers_stay_with_spark():
    kinds = [type(M.forest(*a)) for a in (("classification", {"numTrees": 20, "maxDepth": 6}), ("regression", M.BASELINE["forest"]), ("classification", M.BASELINE["forest"], "weight"))]
    assert kinds == [RandomForestClassifier, RandomForestRegressor, G.TaskForest]
    assert isinstance(M.tuned_estimator("classification", "forest", M.COMPARISON["forest"]), G.TaskForest)


def test_a_stream_is_scored_like_a_table(spark, tmp_path):
    df = table(spark, 200, 8)
    model = G.TaskForest(numTrees=4).fit(df)
    df.select("key", "features", "y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, features array<double>, y double").parquet(str(tmp_path / "in"))
    scored = M.predictions(model, stream, "classification", ["key"])
    scored.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {r.key: (r.score, r.prediction) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert same(got, answers(model, df))
