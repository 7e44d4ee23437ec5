"""Leaf-wise boosting: one round by hand and against plain numpy, growth order, regularisation, learning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import boosting as B
from assayloom.operators import models as M
from assayloom.sources.state import load_model, save_model

ONE = B.Settings(rounds=1, leaves=2, rate=1.0, bins=4, l2=1.0, columns=1.0, rows=1.0)


def plain_tree(x, g, h, s):
    """Leaf-wise growth over raw bins, one leaf at a time: {frozenset of rows: value}."""
    score = lambda rows: B.soft(g[rows].sum(), s.l1) ** 2 / (h[rows].sum() + s.l2)

    def best(rows, depth):
        found = (0.0, None, None)
        for f in range(x.shape[1]):
            for b in range(s.bins):
                a = x[rows, f] <= b
                if depth < s.depth and min(a.sum(), (~a).sum()) >= s.least_rows and min(h[rows[a]].sum(), h[rows[~a]].sum()) >= s.least_hessian:
                    gain = score(rows[a]) + score(rows[~a]) - score(rows)
                    if gain > found[0] + 1e-9:
                        found = (gain, rows[a], rows[~a])
        return found

    leaves = [(np.arange(len(x)), 0)]
    while len(leaves) < s.leaves:
        splits = [best(rows, depth) for rows, depth in leaves]
        top = max(range(len(leaves)), key=lambda i: splits[i][0])
        if splits[top][1] is None:
            break
        _, depth = leaves.pop(top)
        leaves += [(splits[top][1], depth + 1), (splits[top][2], depth + 1)]
    return {frozenset(rows.tolist()): -s.rate * B.soft(g[rows].sum(), s.l1) / (h[rows].sum() + s.l2) for rows, _ in leaves}


@pytest.fixture(scope="module")
def table(spark):
    x = np.random.default_rng(7).normal(size=(240, 5))
    y = np.where(x[:, 0] > 0, x[:, 1] * 2, -x[:, 2]) + x[:, 3] / 4
    df = M.with_vector(spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "key long, features array<double>, y double").repartition(3)).cache()
    return df, x, y


@pytest.mark.parametrize("s", [B.Settings(rounds=1, leaves=9, depth=4, rate=0.5, bins=8, columns=1.0, rows=1.0), B.Settings(rounds=1, leaves=6, depth=9, l1=3.0, l2=0.1, bins=5, least_rows=15, columns=1.0, rows=1.0)])
def test_a_round_equals_plain_growth(table, s):
    df, x, y = table
    model = B.LeafwiseBooster("regression", s).fit(df)
    cuts = B.bin_cuts(df, "features", 5, s.bins)
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(5)], axis=1)
    want = plain_tree(bins, y.mean() - y, np.ones(len(y)), s)
    got = model.margin(x) - y.mean()
    for rows, value in want.items():
        assert got[sorted(rows)] == pytest.approx(value, abs=1e-9)
    assert len(want) == (model.trees.feature >= 0).sum() + 1


def test_a_split_by_hand(spark):
    rows = spark.createDataFrame([(float(i), 1.0 if i >= 6 else 0.0) for i in range(8)], "f double, y double").selectExpr("array(f, 0D) AS features", "y")
    model = B.LeafwiseBooster("regression", ONE).fit(M.with_vector(rows))
    # quantiles 1.75, 3.5, 5.25; mean 0.25; right of 5.25: g = -1.5 over 2 rows, left: 1.5 over 6
    assert model.base == 0.25 and model.trees.feature.tolist() == [0, -1, -1] and model.trees.threshold[0] == 5.25
    assert model.trees.value[1:].tolist() == pytest.approx([-1.5 / 7, 1.5 / 3])


def test_models_reload(table, tmp_path):
    df, x, _ = table
    model = B.LeafwiseBooster("regression", B.Settings(rounds=2, leaves=4, bins=8)).fit(df)
    again = load_model(save_model(model, str(tmp_path / "m")))
    assert (again.margin(x) == model.margin(x)).all() and again.task == "regression"
    with pytest.raises(FileNotFoundError):
        load_model(str(tmp_path / "none"))


def test_regularisation_stops_splits(table):
    df, _, y = table
    model = B.LeafwiseBooster("regression", B.Settings(rounds=3, l1=1e6, bins=4)).fit(df)
    assert len(model.trees.roots) == 0 and model.transform(df).select(F.min("prediction"), F.max("prediction")).first() == (pytest.approx(y.mean()), pytest.approx(y.mean()))


def test_classes_are_learned_and_runs_agree(spark):
    x = np.random.default_rng(0).normal(size=(300, 2))
    df = M.with_vector(spark.createDataFrame([(i, v.tolist(), float(np.hypot(*v) > 1.2)) for i, v in enumerate(x)], "key long, features array<double>, y double").coalesce(2))
    s = B.Settings(rounds=12, leaves=8, rate=0.3, bins=16, columns=0.5, rows=0.8)
    first, second = (B.LeafwiseBooster("classification", s).fit(df) for _ in range(2))
    assert np.allclose(first.explained.base + first.explained.attribute(x).sum(axis=1), first.margin(x))
    assert (first.margin(x) == second.margin(x)).all() and len(first.trees.roots) == 12
    preds = M.predictions(first, df, "classification", ["key"])
    assert M.roc_auc(preds, "score", "y", []).first().auc > 0.95
    heavy = df.withColumn("w", F.when(F.col("y") == 1, 50.0).otherwise(1.0))
    assert (B.LeafwiseBooster("classification", s, "w").fit(heavy).margin(x) > 0).mean() > (first.margin(x) > 0).mean()
    with pytest.raises(ValueError):
        B.LeafwiseBooster("regression", s).fit(df.limit(0))
