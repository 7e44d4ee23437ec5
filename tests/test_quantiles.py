"""Percentiles of all places of a vector column against sorted lists."""

import numpy as np
import pytest

from assayloom.operators.quantiles import from_ordered_bits, ordered_bits, vector_percentiles

PROBS, NAMES = [0.0, 0.25, 0.5, 0.95, 1.0], list("abcde")
SCHEMA = "v array<double>"


def test_bits_keep_the_order():
    x = np.array([-np.inf, -1e300, -2.0, -1.0, -5e-324, 0.0, 5e-324, 1.0, 1.5, 1e300, np.inf])
    key = ordered_bits(x)
    assert (np.diff(key) > 0).all() and [from_ordered_bits(int(k)) for k in key] == x.tolist()
    assert ordered_bits(np.array([-0.0]))[0] == ordered_bits(np.array([0.0]))[0]


@pytest.mark.parametrize("tasks", [1, 7])
def test_against_sorted_values(spark, tasks):
    rng = np.random.default_rng(0)
    m = np.column_stack([
        rng.normal(size=501), rng.normal(1000, 1e-9, 501), rng.integers(-2, 3, 501), np.exp(rng.normal(0, 200, 501)) * rng.choice([-1, 1], 501),
        np.full(501, 7.25), np.where(rng.random(501) < 0.9, np.nan, rng.normal(size=501)),
    ])
    rows = [([None if np.isnan(x) and i % 2 else float(x) for x in row],) for i, row in enumerate(m)]
    got = {r.idx: r for r in vector_percentiles(spark.createDataFrame(rows, SCHEMA).repartition(tasks), "v", PROBS, NAMES).collect()}
    assert sorted(got) == list(range(6))
    for f, r in got.items():
        column = m[:, f][~np.isnan(m[:, f])]
        assert np.allclose([r[n] for n in NAMES], np.quantile(column, PROBS), rtol=1e-12, atol=0)


def test_odd_vectors(spark):
    inf = float("inf")
    rows = [([1.0, None, inf, -0.0],), ([2.0],), (None,), ([],), ([3.0, float("nan"), -inf, 0.0, None],), ([4.0, None, 1.0, 0.0],)]
    got = {r.idx: (r.lo, r.mid, r.hi) for r in vector_percentiles(spark.createDataFrame(rows, SCHEMA), "v", [0, 0.5, 1], ["lo", "mid", "hi"]).collect()}
    assert got == {0: (1.0, 2.5, 4.0), 2: (-inf, 1.0, inf), 3: (0.0, 0.0, 0.0)}
    for empty in (rows[2:4], [], [([None],)]):
        assert vector_percentiles(spark.createDataFrame(empty, SCHEMA), "v", [0.5], ["m"]).collect() == []


def test_entries_are_not_unfolded(spark):
    """The shuffle carries counts: two hundred copies of the rows do not add a row to it."""
    from assayloom.operators.quantiles import _digit_counts

    one = spark.createDataFrame([([float(i), float(i % 3)],) for i in range(50)], SCHEMA).coalesce(1)
    plan = lambda df: {(r.idx, r.digit): r.n for r in _digit_counts(df, "v", 2, 0, None).collect()}
    few, many = plan(one), plan(one.selectExpr("explode(array_repeat(v, 200)) AS v"))
    assert few.keys() == many.keys() and {k: 200 * n for k, n in few.items()} == many
