"""Exact order statistics against brute force, including concentrated, tied and negative values."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayloom.operators.ordered import exact_percentiles, first_by, median_by_key, running_totals, value_bin, value_cell


def frame(spark, values, group=None):
    rows = [(i, g, v) for i, (v, g) in enumerate(zip(values, group or ["a"] * len(values)))]
    return spark.createDataFrame(rows, "id long, g string, v double")


CASES = {
    "spread": np.random.default_rng(1).normal(0, 100, 500).tolist(),
    "ties": [1.0] * 200 + [2.0] * 3 + [0.0] * 50,
    "near_one": (1 - np.random.default_rng(2).random(400) * 1e-9).tolist(),
    "near_zero": (np.random.default_rng(3).random(400) * 1e-12).tolist() + [0.0, -0.0, -1e-13, 1e-300],
    "wide": [10.0**k for k in range(-20, 20)] + [-(10.0**k) for k in range(-20, 20)],
    "one": [3.5],
    "two": [1.0, 2.0],
}


@pytest.mark.parametrize("name", CASES)
def test_percentiles_match_numpy(spark, name):
    values = CASES[name]
    got = exact_percentiles(frame(spark, values), ["g"], "v", [0.0, 0.25, 0.5, 0.95, 1.0], list("abcde")).first()
    want = np.percentile(values, [0, 25, 50, 95, 100])
    assert np.allclose([got[c] for c in "abcde"], want, rtol=1e-12, atol=0)


@pytest.mark.parametrize("name", CASES)
def test_running_totals_match_sort(spark, name):
    values = CASES[name]
    rows = running_totals(frame(spark, values), ["g"], "v", {"n": F.lit(1)}).collect()
    s = sorted(values)
    assert sum(r.n for r in rows) == len(values)
    for r in rows:
        assert r.n_before == sum(x < r.v for x in s) and r.n_total == len(s)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False, min_value=-1e200, max_value=1e200), min_size=1, max_size=60))
def test_bins_and_cells_are_monotone(spark, values):
    df = frame(spark, values).withColumn("b", value_bin(F.col("v"))).withColumn("c", value_cell(F.col("v"), F.col("b")))
    rows = sorted(df.collect(), key=lambda r: r.v)
    places = [(r.b, r.c) for r in rows]
    assert places == sorted(places)


def test_groups_nulls_and_null_keys(spark):
    df = frame(spark, [1.0, None, 3.0, 10.0, None, 5.0], ["a", "a", "a", None, None, "b"])
    got = {r.g: r.m for r in exact_percentiles(df, ["g"], "v", [0.5], ["m"]).collect()}
    assert got == {"a": 2.0, None: 10.0, "b": 5.0}


def test_hot_and_cold_medians_agree(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(6, 1, 3000).tolist()
    groups = ["hot"] * 2000 + [f"k{i % 100}" for i in range(1000)]
    df = frame(spark, values, groups)
    want = pd.DataFrame({"g": groups, "v": values}).groupby("g").v.median().to_dict()
    got = {r.g: r.m for r in median_by_key(df, ["g"], "v", "m").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_first_by_is_independent_of_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("ord"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
    one = sorted(map(tuple, first_by(df.repartition(13), ["k"], ["ord"]).collect()))
    two = sorted(map(tuple, first_by(df.orderBy(F.desc("ord")), ["k"], ["ord"]).collect()))
    assert one == two and [r[1] for r in one] == list(range(7))
