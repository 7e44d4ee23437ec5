"""Guided search against a plain evaluation, random draws, and by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import models as M
from assayloom.operators import search as S
from assayloom.operators.splits import repeated_stratified_kfold

SPACE = {"x": ("float", -5.0, 5.0), "rate": ("log", 1e-4, 1.0), "n": ("step", 100, 500, 50), "d": ("int", 1, 9), "kind": ("choice", "a", "b", "c")}


def objective(p, rung=0):
    return -((p["x"] - 2) ** 2) - (math.log10(p["rate"]) + 2) ** 2 - (p["n"] - 300) ** 2 / 1e4 - abs(p["d"] - 4) / 3 + (p["kind"] == "b") + rung / 100


def run(seed, guided=True, stop=False, trials=60):
    return S.search(SPACE, lambda now, rung: [objective(t.params, rung) for t in now], trials, 3, 4, seed, guided, stop)


def test_proposals_stay_in_range():
    for t in run(1):
        p = t.params
        assert -5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1 and p["n"] in range(100, 501, 50) and p["d"] in range(1, 10) and p["kind"] in "abc"


def test_guided_search_beats_random_draws():
    guided = [S.best(run(s)).value for s in range(12)]
    drawn = [S.best(run(s, guided=False)).value for s in range(12)]
    assert np.mean(guided) > np.mean(drawn) + 0.3 and sum(g > d for g, d in zip(guided, drawn)) >= 9


def test_poor_trials_stop_early_and_the_best_is_whole():
    trials = run(3, guided=False, stop=True)
    used = sum(len(t.scores) for t in trials)
    assert used < 0.8 * 180 and sum(len(t.scores) for t in run(3, stop=True)) < 180 and all(len(t.scores) == 3 for t in trials if not t.stopped)
    assert any(t.stopped and len(t.scores) == 1 for t in trials) and len(S.best(trials).scores) == 3
    assert [t.number for t in trials] == list(range(60))


def test_stopping_rule_by_hand():
    scores = iter([[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]])
    seen = []

    def evaluate(now, rung):
        seen.append((rung, [t.number for t in now]))
        return next(scores)

    got = S.search(SPACE, evaluate, 4, 2, 4)
    assert seen == [(0, [0, 1, 2, 3]), (1, [2, 3])] and [t.stopped for t in got] == [True, True, False, False]
    assert S.best(got).number == 3 and S.best(got).value == 5.0


def test_failed_scores_rank_last_and_ties_go_to_the_first():
    got = S.search({"k": ("choice", 1)}, lambda now, rung: [math.nan if t.number == 0 else 1.0 for t in now], 12, 1)
    assert S.best(got).number == 1 and got[0].value == -math.inf


def test_spark_objective_gives_the_same_trials_as_a_plain_one(spark, data):
    """Stumps on embeddings: scores counted by Spark and by numpy lead the search the same way."""
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("e"), (F.col("label") >= 5).alias("y")).cache()
    local = table.toPandas()
    x, y = np.stack(local["e"].to_numpy()), local["y"].to_numpy()
    space = {"feature": ("int", 0, 63), "cut": ("float", -0.3, 0.3), "side": ("choice", "over", "under")}

    def by_spark(now, rung):
        def hit(p):
            value = F.get("e", F.lit(p["feature"]))
            return F.count_if((value > p["cut"] if p["side"] == "over" else value <= p["cut"]) == F.col("y"))

        row = table.where(F.col("vec_id") % 3 == rung).agg(*[hit(t.params).alias(str(t.number)) for t in now]).first()
        return [row[str(t.number)] for t in now]

    def by_numpy(now, rung):
        fold = local["vec_id"].to_numpy() % 3 == rung
        sides = [x[fold, t.params["feature"]] > t.params["cut"] for t in now]
        return [int(((s if t.params["side"] == "over" else ~s) == y[fold]).sum()) for s, t in zip(sides, now)]

    a, b = (S.search(space, f, 24, 3, 6, 5) for f in (by_spark, by_numpy))
    assert [(t.params, t.scores, t.stopped) for t in a] == [(t.params, t.scores, t.stopped) for t in b]


def test_weight_ranges_and_columns(spark):
    assert M.weight_space("classification", "boosted", 10, 40) == {"positive_weight": ("float", 1.0, 8.0)}
    assert M.weight_space("classification", "boosted", 40, 10) == {"positive_weight": ("float", 0.125, 1.0)}
    assert M.weight_space("regression", "forest", 1, 1) == {} and M.weight_space("classification", "forest", 1, 1)["class_weight"][0] == "choice"
    df = spark.createDataFrame([(0.0,)] * 3 + [(1.0,)], "y double")
    rows, rest, name = M.with_class_weight(df, {"class_weight": "balanced", "maxDepth": 3})
    assert rest == {"maxDepth": 3} and {(r.y, round(r[name], 6)) for r in rows.collect()} == {(0.0, round(4 / 6, 6)), (1.0, 2.0)}
    rows, rest, name = M.with_class_weight(df, {"positive_weight": 2.5})
    assert {(r.y, r[name]) for r in rows.collect()} == {(0.0, 1.0), (1.0, 2.5)} and M.with_class_weight(df, {"class_weight": "none"})[2] is None


def test_regression_tuning_finds_a_trial(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist(), float(v[0])) for i, v in enumerate(rng.normal(size=(90, 2)))]
    table = spark.createDataFrame(rows, "key long, features array<double>, y double")
    folds = repeated_stratified_kfold(table.selectExpr("key", "cast(y > 0 as double) as y"), "key", "y", 2, 1)
    trials, won = M.tune(table, folds, "regression", 4, 2, ("forest",), {"forest": {"numTrees": 5}})
    assert trials.count() == 4 and won["score"] > 0.3 and won["params"]["numTrees"] == 5
