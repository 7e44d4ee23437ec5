"""Published screening tables and hand-made risk cases."""

import pytest
from pyspark.sql import functions as F

from assayloom.functions import scores as S
from assayloom.functions import text as W
from assayloom.operators import explain as E
from assayloom.operators import risk as R
from assayloom.operators import screening as G
from assayloom.operators import similarity as Y
from assayloom.operators.lookup import ENDPOINTS

NAMES = ["Acetaminophen", "Aspirin", "Caffeine", "Ibuprofen", "Terfenadine", "Diclofenac", "Naproxen", "Warfarin"]
HERG = [-6.4, -6.2, -5.4, -7.1, -9.1, -7.8, -6.9, -8.3]
HEPATOTOX = [-6.8, -7.0, -6.1, -7.7, -8.8, -8.5, -8.9, -10.2]


@pytest.fixture(scope="module")
def batch(spark):
    rows = [(n, t, p, True, v) for t, p, vs in (("herg", 0, HERG), ("hepatotox", 1, HEPATOTOX)) for n, v in zip(NAMES, vs)]
    return spark.createDataFrame(rows, "name string, target string, target_pos int, success boolean, affinity double")


def test_best_targets(batch):
    got = {r.name: (r.best_target, r.best_affinity) for r in G.best_target(batch, ["name"]).collect()}
    assert got.pop("Terfenadine") == ("herg", -9.1)
    assert all(t == "hepatotox" for t, _ in got.values())


def test_summary_and_distribution(batch):
    rows = {r.target: r for r in G.screen_summary(batch, "name").collect()}
    h, p = rows["herg"], rows["hepatotox"]
    assert [h.success_rate, round(h.mean_affinity, 6), h.min_affinity, h.max_affinity, round(h.std_affinity, 6)] == [100, -7.15, -9.1, -5.4, 1.125833]
    assert [h.strong_binders, h.moderate_binders, h.weak_binders] == [2, 5, 1]
    assert [round(p.mean_affinity, 6), round(p.std_affinity, 6), p.strong_binders, p.moderate_binders, p.weak_binders] == [-8.0, 1.258968, 4, 4, 0]
    d = G.risk_distribution(G.best_target(batch, ["name"])).first()
    assert [d.high_risk, d.moderate_risk, d.low_risk, d.no_binding_data] == [4, 4, 0, 0]


def test_zero_positive_and_failed_affinities(spark):
    rows = [("a", "x", 0, True, 0.0), ("a", "y", 1, True, 2.0), ("b", "x", 0, False, -9.0), ("c", "x", 0, True, -7.0), ("c", "y", 1, True, -7.0)]
    df = spark.createDataFrame(rows, "name string, target string, target_pos int, success boolean, affinity double")
    got = {r.name: r.best_target for r in G.best_target(df, ["name"]).collect()}
    assert got == {"a": None, "b": None, "c": "x"}
    wide = {r.name: r for r in G.pivot_results(df, ["name"], ["x", "y"]).collect()}
    assert wide["b"].y_success is False and wide["b"].y_affinity is None and wide["a"].y_affinity == 2.0


def test_affinity_scale(spark):
    df = spark.createDataFrame([(-6.4,), (-12.5,), (-3.0,), (None,)], "a double")
    assert [round(r.x, 6) for r in df.select(S.affinity_to_risk(F.col("a")).alias("x")).collect()] == [.3, 1, 0, .5]


def test_published_assessment(spark):
    scores = {"herg": .104, "hepatotox": .796, "nephrotox": .301, "ames": .020, "skin_sens": .641, "cytotox": .026}
    rows = [("k", e, "classification", 0.0, p, True) for e, p in scores.items()] + [("bad", "herg", "regression", None, None, False)]
    df = spark.createDataFrame(rows, "key string, endpoint string, task_type string, prediction double, probability double, success boolean")
    got = {r.key: r for r in R.integrated_assessment(df, "key").collect()}
    k = got["k"]
    assert (k.overall_risk_score, k.overall_risk_level, k.critical_endpoint) == (.796, "high", "hepatotox")
    assert k.endpoint_ranking == ["hepatotox", "skin_sens", "nephrotox", "herg", "cytotox", "ames"]
    assert k.endpoint_risk_levels["nephrotox"] == "moderate" and k.endpoint_risk_scores == scores and k.error is None
    assert got["bad"].error == "No valid predictions" and got["bad"].overall_risk_score is None


def test_tied_scores_keep_endpoint_order_and_zero_has_no_critical_score(spark):
    rows = [("k", e, "classification", 0.0, 0.0, True) for e in reversed(ENDPOINTS)]
    df = spark.createDataFrame(rows, "key string, endpoint string, task_type string, prediction double, probability double, success boolean")
    got = R.integrated_assessment(df, "key").first()
    assert got.endpoint_ranking == list(ENDPOINTS) and got.critical_endpoint_score is None and got.overall_risk_level == "low"


def test_enhanced_score_published(spark):
    df = spark.createDataFrame([(True, True, -6.4, "good", "high", "good"), (False, True, -6.4, "good", "high", "good")],
                               "success boolean, descriptors_success boolean, affinity double, shape_compatibility string, pharmacophore_match string, size_compatibility string")
    ok, bad = R.enhanced_score(df).collect()
    assert ok.enhanced_score == .3795 and ok.enhanced_risk == "moderate"
    assert (bad.enhanced_score, bad.enhanced_confidence, bad.enhanced_risk) == (.5, "low", "unknown")


def test_weights():
    assert S.normalise_weights(0.0, 0.3) == (0.0, 1.0)
    with pytest.raises(ValueError):
        S.normalise_weights(0, 0)


def test_recommendations_deduplicate_and_sort(spark):
    rows = [("k", "low", "t", "b", "r", 0), ("k", "high", "t", "a", "r", 1), ("k", "medium", "t", "a", "x", 2)]
    df = spark.createDataFrame(rows, "key string, priority string, type string, recommendation string, reason string, pos int")
    got = [(r.recommendation, r.priority) for r in E.distinct_recs(df, ["key"]).orderBy("place").collect()]
    assert got == [("a", "high"), ("b", "low")]


def test_interpretation_of_nothing(spark):
    df = spark.createDataFrame([([],)], "v array<double>")
    assert df.select(W.interpretation_text(E.top_of_array(F.col("v"), 5), F.lit("herg")).alias("t")).first().t == "No significant features identified."


def test_tanimoto(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), (None, [1]), ([], [])], "a array<int>, b array<int>")
    assert [r.s for r in df.select(Y.tanimoto(F.col("a"), F.col("b")).alias("s")).collect()] == [.5, 0.0, 0.0]


def test_search_agrees_with_brute_force(spark):
    import random

    draw = random.Random(3)
    sets = {i: sorted(draw.sample(range(64), draw.randint(1, 20))) for i in range(120)}
    sets.update({i: sets[0] for i in range(200, 240)})
    lib = spark.createDataFrame(list(sets.items()), "key long, bits array<int>")
    queries = spark.createDataFrame([(i, sets[i]) for i in range(30)], "q long, bits array<int>")
    for least in (0.2, 0.5, 1.0):
        want = {(q, k) for q in range(30) for k in sets if len(set(sets[q]) & set(sets[k])) / len(set(sets[q]) | set(sets[k])) >= least}
        for route in ("blocks", "index", None):
            got = Y.tanimoto_search(lib, queries, "key", "q", "bits", least, 64, route).collect()
            assert {(r.q, r.key) for r in got} == want and len(got) == len(want)
            assert all(r.similarity == pytest.approx(len(set(sets[r.q]) & set(sets[r.key])) / len(set(sets[r.q]) | set(sets[r.key]))) for r in got)


def test_index_meets_each_pair_once_and_few_of_them(spark):
    import random

    draw = random.Random(5)
    sets = {i: sorted(draw.sample(range(2048), 40)) for i in range(300)}
    sets.update({300 + i: sorted({*sets[i][:38], 2047 - i, 1000 + i}) for i in range(20)})
    rows = spark.createDataFrame(list(sets.items()), "key long, bits array<int>")
    pairs = Y.candidates(rows, rows.selectExpr("key AS q", "bits"), "bits", 0.8, 2048)
    met = [(r.key, r.q) for r in pairs.select("key", "q").collect()]
    near = {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    assert len(met) == len(set(met)) and near <= set(met) and len(near) >= 360 and len(met) < 0.05 * len(sets) ** 2
    odd = spark.createDataFrame([(None, [1, 2]), (1, None), (2, []), (3, [1, 2])], "key long, bits array<int>")
    for route in ("blocks", "index"):
        got = Y.tanimoto_search(odd, odd.withColumnRenamed("key", "q"), "key", "q", "bits", 0.5, 64, route).collect()
        assert sorted((r.q is None, r.key is None, r.similarity) for r in got) == sorted((a, b, 1.0) for a in (True, False) for b in (True, False))
    none = odd.limit(0)
    assert Y.tanimoto_search(odd, none.withColumnRenamed("key", "q"), "key", "q", "bits", 0.5, 64).count() == 0


def test_index_compares_inside_the_task(spark, monkeypatch):
    """Pieces of every size give the same pairs, and only pairs that reach the threshold leave the index."""
    import random

    import numpy as np
    import pyarrow as pa

    draw = random.Random(7)
    sets = {i: sorted(draw.sample(range(100), draw.randint(1, 30))) for i in range(90)}
    want = {(a, b) for a in sets for b in sets if len(set(sets[a]) & set(sets[b])) >= 0.1 * len(set(sets[a]) | set(sets[b]))}
    monkeypatch.setattr(Y, "PART_ROWS", 20)
    monkeypatch.setattr(Y, "MOST_ASKED", 25)
    rows = spark.createDataFrame(list(sets.items()), "key long, bits array<int>")
    got = Y.candidates(rows, rows.selectExpr("key AS q", "bits"), "bits", 0.1, 100).collect()
    assert len(got) == len(want) and {(r.key, r.q) for r in got} == want
    lists = pa.array(list(sets.values()), pa.list_(pa.int32()))
    for name, least in (("MOST_MET", 50), ("MOST_MET", 400), ("CHECKED", 7)):
        monkeypatch.setattr(Y, name, least)
        pieces = list(Y._met(lists, lists, np.random.default_rng(1).permutation(100), 0.1, 100))
        assert len(pieces) > 9 and sorted((i, j) for a, b, _ in pieces for i, j in zip(a.tolist(), b.tolist())) == sorted(want)


def test_word_ngrams(spark):
    df = spark.createDataFrame([("A b  c, a B",), ("x",), ("",)], "t string")
    assert [r.x for r in df.select(Y.tokens(F.col("t")).alias("x")).collect()] == [["a", "b", "c"], ["x"], []]
    assert [r.x for r in df.select(Y.tokens(F.col("t"), 2).alias("x")).collect()] == [["a b", "b c", "c a"], [], []]
