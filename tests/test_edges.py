"""Nulls, infinite values, repeated rows and names outside the configured lists."""

import pytest
from pyspark.sql import functions as F

from assayloom import session
from assayloom.operators import curation, features, lookup, metrics, ordered, risk, scoring, screening, similarity, splits

INF, NAN = float("inf"), float("nan")


def test_order_statistics_take_infinite_values_and_leave_out_nan(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", INF), ("b", 1.0), ("b", 2.0), ("b", NAN), ("c", INF), ("c", INF), ("d", -INF), ("d", None), ("e", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in ordered.median_by_key(df, ["k"], "v", "m").collect()}
    assert got == {"a": 2.0, "b": 1.5, "c": INF, "d": -INF, "e": None, None: 3.0}
    auc = metrics.roc_auc(spark.createDataFrame([(1.0, 0), (2.0, 0), (INF, 1), (NAN, 1)], "s double, y int"), "s", "y")
    assert auc.first().auc == 1.0


def test_numbers_read_from_text_are_finite(spark):
    df = spark.createDataFrame([("1.5",), ("Infinity",), ("-inf",), ("nan",), ("x",), (None,)], "v string")
    assert [r.v for r in curation.coerce_numeric(df, "v").collect()] == [1.5, None, None, None, None, None]
    out = features.featurize_once(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, t string"), "k", "t", lambda s: [INF if s == "1" else 1.0])
    assert sorted((r.k, r.features, r.failed) for r in out.collect()) == [("a", None, True), ("b", [1.0], False)]


def test_confusion_counts_rows_with_both_sides(spark):
    df = spark.createDataFrame([(1, 1), (0, 0), (None, 1), (1, None)], "y int, p int")
    row = metrics.classification_metrics(df, "y", "p").first()
    assert (row.n, row.accuracy) == (2, 1.0)


def test_splits_keep_null_labels_and_keys(spark):
    rows = [(str(i) if i >= 20 else None, None if i % 3 == 0 else i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, y int")
    parts = [(r.k, r.split) for r in splits.split(df, "k").collect()]
    assert len(parts) == 60 and {s for k, s in parts if k is None} == {"train"}
    assert sum(s == "test" for _, s in parts) == 8 and sum(s == "val" for _, s in parts) == 4
    assert splits.stratified_split(df, "k", "y").count() == 60
    folds = splits.repeated_kfold(df, "k", 3, 2, label="y").collect()
    assert len(folds) == 120 and {r.fold for r in folds if r.k is None} == {0} and {r.fold for r in folds} == {0, 1, 2}
    weights = {r.y: r.weight for r in splits.balanced_weights(df, "y").collect()}
    assert weights == {None: None, 1: 1.0, 2: 1.0} and splits.balanced_weights(df, "y").count() == 60


def test_score_missing_with_null_and_repeated_keys(spark):
    requests = spark.createDataFrame([("a",), (None,), ("b",), ("b",)], "k string")
    cache = spark.createDataFrame([("a", 2.0, True), ("a", 1.0, True), ("b", 9.0, False)], "k string, v double, success boolean")
    scorer = lookup.python_scorer(lambda batch: [(5.0, True)] * len(batch), "v double, success boolean")
    results, kept = lookup.score_missing(requests, cache, ["k"], scorer)
    assert sorted(((r.k or ""), r.v) for r in results.collect()) == [("", 5.0), ("a", 1.0), ("b", 5.0), ("b", 5.0)]
    assert kept.count() == 3
    assert lookup.python_scorer(lambda b: [], "v decimal(10,2), s struct<a:int,b:int>") is not None


def test_endpoints_and_targets_outside_the_lists_count(spark):
    preds = spark.createDataFrame(
        [("x", "brand_new", "classification", 1.0, 0.95, True), ("x", "hepatotoxicity", "classification", 0.0, 0.1, True), ("x", None, "classification", 1.0, 0.99, True)],
        "key string, endpoint string, task_type string, prediction double, probability double, success boolean",
    )
    row = risk.integrated_assessment(preds, "key").first()
    assert (row.overall_risk_score, row.critical_endpoint) == (0.95, "brand_new") and set(row.endpoint_risk_scores) == {"brand_new", "hepatotoxicity"}
    assert set(scoring.multi_endpoint_map(preds, "key").first().results) == {"brand_new", "hepatotoxicity"}
    docked = spark.createDataFrame(
        [("x", "e", "zz", True, -9.0, 0.9, "high"), ("x", "e", "aa", True, -8.0, 0.8, "high")],
        "key string, endpoint string, target string, success boolean, affinity double, enhanced_score double, enhanced_risk string",
    )
    assert screening.endpoint_summary(docked, ["key", "endpoint"]).first().high_risk_targets == ["aa", "zz"]


def test_similarity_needs_a_threshold(spark):
    df = spark.createDataFrame([(1, [1, 2])], "k int, bits array<int>")
    with pytest.raises(ValueError):
        similarity.tanimoto_search(df, df.withColumnRenamed("k", "q"), "k", "q", "bits", 0.0)


def test_a_cluster_needs_a_shared_folder():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(RuntimeError):
        session.work_root(Fake)
