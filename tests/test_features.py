import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import domain as D
from assayloom.operators import features as X
from assayloom.operators import resample as Z
from assayloom.sources.state import load_state, save_state


def table(spark, matrix, schema="key long, features array<double>"):
    return spark.createDataFrame([(i, [None if v is None else float(v) for v in r]) for i, r in enumerate(matrix)], schema)


def back(df):
    return np.array([r.features for r in df.orderBy("key").collect()], dtype=float)


@pytest.fixture(scope="module")
def normal():
    return np.random.default_rng(0).normal(3, 2, (200, 4))


def test_filters_on_gaps_constants_and_empty_columns(spark):
    df = table(spark, [[1, None, 5, None], [2, None, 5, 1], [3, None, 5, 1], [4, None, 5, 2], [5, None, 5, 2]])
    stats = X.feature_stats(df, "features")
    assert X.kept_indices(X.missing_fraction_filter(stats)) == [0, 2]
    assert X.kept_indices(X.missing_fraction_filter(stats, 0.2, strict=False)) == [0, 2, 3]
    assert X.kept_indices(X.zero_std_filter(stats)) == [0, 3]
    filled = X.impute_median(df, "features", X.feature_medians(df, "features"), 4, zero_left=True)
    assert back(filled)[0].tolist() == [1, 0, 5, 1.5]
    left = X.impute_median(df, "features", X.feature_medians(df, "features"), 4)
    assert left.orderBy("key").first().features == [1.0, None, 5.0, 1.5]


def test_scalers_match_numpy(spark, normal):
    m = np.c_[normal, np.full(200, 7.0)]
    df = table(spark, m)
    state = X.fit_standard(df, "features")
    out = back(X.scale(df, "features", state))
    sd = m.std(0)
    assert np.allclose(out, (m - m.mean(0)) / np.where(sd == 0, 1, sd))
    assert np.allclose(back(X.scale(X.scale(df, "features", state), "features", state, inverse=True)), m)
    q = np.percentile(m, [25, 50, 75], axis=0)
    w = q[2] - q[0]
    assert np.allclose(back(X.scale(df, "features", X.fit_robust(df, "features"))), (m - q[1]) / np.where(w == 0, 1, w))


def test_correlated_with_dropped_column_is_dropped(spark, normal):
    a, b = normal[:, 0], normal[:, 1]
    m = np.c_[a, a * 2 + 1, b, -a + 1e-9, np.full(200, 1.0)]
    assert X.correlated_places(table(spark, m), "features") == {1, 3}


def test_selection_caps_in_variance_order_and_checks_names(spark, normal, tmp_path):
    m = normal * np.array([1.0, 3.0, 2.0, 1e-4])
    df = table(spark, m)
    out, state = X.select_features(df, "features", ["a", "b", "c", "d"], F.col("key") < 150, most=2)
    assert [r.feature for r in state.orderBy("idx").collect()] == ["b", "c"]
    assert np.allclose(back(out), m[:, [1, 2]])
    saved = load_state(spark, save_state(state, str(tmp_path / "s")))
    swapped = X.select_places(df, "features", [2, 1, 0])
    assert np.allclose(back(X.apply_selection(swapped, "features", ["c", "b", "a"], saved)), m[:, [1, 2]])
    with pytest.raises(ValueError, match="missing 1 expected"):
        X.apply_selection(df, "features", ["a", "b"], saved)
    with pytest.raises(FileNotFoundError):
        load_state(spark, str(tmp_path / "none"))


def test_matrix_cleaning_with_nothing_left(spark):
    with pytest.raises(ValueError, match="all features"):
        X.clean_feature_matrix(table(spark, [[1, 2]] * 5), "features", ["a", "b"])


@pytest.mark.parametrize("n, p, want", [
    (1057, 500, 1.4219489120), (105, 500, 14.3142857143), (106, 500, 14.1792452830),
    (118, 500, 12.7372881356), (88, 500, 17.0795454545), (44, 318, 21.75), (7462, 500, 0.2014205),
])
def test_published_thresholds(n, p, want):
    assert abs(D.leverage_threshold(n, p) - want) < 1e-7


def test_leverage_matches_numpy_and_trace_is_rank(spark, normal):
    m = np.c_[normal, normal[:, 0] + normal[:, 1]]
    df = table(spark, m)
    domain = D.fit_leverage(df, "features")
    h = np.array([r.h for r in D.add_domain_value(df, "features", domain).orderBy("key").collect()])
    want = np.einsum("ij,jk,ik->i", m, np.linalg.pinv(m.T @ m), m)
    assert np.allclose(h, want) and abs(h.sum() - 4) < 1e-6


def test_fewer_rows_than_features(spark):
    m = np.random.default_rng(4).normal(size=(6, 10))
    domain = D.fit_leverage(table(spark, m), "features")
    h = [r.h for r in D.add_domain_value(table(spark, m), "features", domain).collect()]
    assert np.allclose(h, 1.0)


def test_distance_domain_and_state(spark, normal):
    df = table(spark, normal)
    domain = D.fit_distance(df, "features")
    d = np.linalg.norm(normal - normal.mean(0), axis=1)
    assert abs(domain.threshold - np.percentile(d, 95)) < 1e-9
    again = D.from_rows(D.save_rows(domain, spark))
    assert again == domain
    lever = D.fit_leverage(df, "features")
    assert D.from_rows(D.save_rows(lever, spark)) == lever
    assert D.refit_if_needed(domain, df, "features", 4) is domain
    assert D.refit_if_needed(domain, X.select_places(df, "features", [0, 1]), "features", 2, "distance").n_features == 2
    rel = [r.x for r in D.assess(df, "features", domain).select(D.reliability(F.col("h"), domain.threshold).alias("x")).collect()]
    assert np.allclose(rel, 1 - np.clip(d / (2 * domain.threshold), 0, 1))


def test_no_domain_means_inside(spark):
    assert tuple(spark.range(1).select(D.domain_flag(None).alias("f")).first().f) == (True, 1.0)


def imbalanced(spark, small=30, large=100):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 3).tolist(), 0.0) for i in range(large)] + [(large + i, rng.normal(5, 1, 3).tolist(), 1.0) for i in range(small)]
    return spark.createDataFrame(rows, "key long, features array<double>, y double")


@pytest.mark.parametrize("how", [{}, {"block": 10}])
def test_smote_fills_between_minority_rows(spark, how):
    df = imbalanced(spark)
    out = Z.smote(df, "key", "features", "y", **how).collect()
    made = np.array([r.features for r in out if r.key is None])
    own = np.array([r.features for r in out if r.key is not None and r.y == 1])
    assert len(made) == 70 and {r.y for r in out if r.key is None} == {1.0}
    assert (made >= own.min(0) - 1e-9).all() and (made <= own.max(0) + 1e-9).all()
    again = np.array([r.features for r in Z.smote(df.repartition(5), "key", "features", "y", **how).collect() if r.key is None])
    assert np.allclose(np.sort(made, 0), np.sort(again, 0))


def test_smote_leaves_balanced_single_and_tiny_classes(spark):
    for df in (imbalanced(spark, 60, 100), imbalanced(spark, 0, 10), imbalanced(spark, 1, 10)):
        assert Z.smote(df, "key", "features", "y").count() == df.count()


def test_featurize_once_counts_failures(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "x"), ("c", "3")], "key string, t string")
    cache = spark.createDataFrame([("c", [9.0], False)], "key string, features array<double>, failed boolean")
    out = X.featurize_once(df, "key", "t", lambda s: [float(s)], cache)
    assert sorted((r.key, r.features, r.failed) for r in out.collect()) == [("a", [1.0], False), ("b", None, True), ("c", [9.0], False)]
    assert tuple(X.failure_count(out).first()) == (3, 1)


def test_leverage_of_nearly_repeated_features(spark):
    """Two features that differ by 1e-9: X'X has lost the difference, its square root has not."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    m = np.c_[x, x[:, 0] + 1e-9 * rng.normal(size=400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, features array<double>").repartition(11)
    domain = D.fit_leverage(df, "features")
    got = {r.id: r.h for r in D.add_domain_value(df, "features", domain).collect()}
    q = np.linalg.qr(m)[0]
    assert domain.n_train == 400 and max(abs(got[i] - (q[i] ** 2).sum()) for i in range(400)) < 1e-5
    assert sum(got.values()) == pytest.approx(4, abs=1e-5)


def test_triangles_of_many_tasks_and_few_rows(spark):
    m = np.random.default_rng(6).normal(size=(30, 6))
    df = spark.createDataFrame([(v.tolist(),) for v in m], "features array<double>").repartition(70)
    r, n = D.triangular_factor(df, "features")
    assert n == 30 and np.allclose(r.T @ r, m.T @ m)
    few, n = D.triangular_factor(df.limit(2).repartition(3), "features")
    assert n == 2 and few.shape[1] == 6 and np.linalg.matrix_rank(few) == 2
    flat = spark.createDataFrame([([0.0, 0.0],)] * 3, "features array<double>")
    assert D.fit_leverage(flat, "features").method == "distance"
