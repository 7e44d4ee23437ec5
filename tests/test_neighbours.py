"""Exact neighbours against brute force, at every block size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayloom.operators import neighbours as N
from assayloom.operators import resample as Z


def table(spark, x):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rid long, v array<double>")
    return rows.withColumn("h", F.col("rid")).repartition(5)


def brute(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return {i: [int(p) for p in np.argsort(d[i], kind="stable")[: min(k, len(x) - 1)]] for i in range(len(x))}


CASES = {
    "plane": lambda r: r.normal(size=(400, 2)),
    "wide": lambda r: r.normal(size=(150, 20)),
    "copies": lambda r: np.r_[np.ones((200, 3)), r.normal(size=(100, 3))],
    "grid": lambda r: r.integers(0, 5, size=(200, 3)).astype(float),
    "far from zero": lambda r: 1e4 + r.normal(size=(200, 3)),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("block", [25, 5000])
def test_neighbours_are_those_of_brute_force(spark, name, block):
    x = CASES[name](np.random.default_rng(3))
    got = {r.rid: [p.rid for p in r.near] for r in N.nearest(table(spark, x), 5, len(x), x.shape[1], block).collect()}
    assert got == brute(x, 5)


def test_few_rows_and_no_rows(spark):
    x = np.array([[0.0], [3.0], [1.0]])
    got = {r.rid: [(p.rid, p.d) for p in r.near] for r in N.nearest(table(spark, x), 5, 3, 1, 1).collect()}
    assert got == {0: [(2, 1.0), (1, 9.0)], 1: [(2, 4.0), (0, 9.0)], 2: [(0, 1.0), (1, 4.0)]}
    assert N.nearest(table(spark, x).limit(0), 5, 0, 1).count() == 0
    assert [len(r.near) for r in N.nearest(table(spark, x[:1]), 5, 1, 1).collect()] == [0]


def test_few_blocks_are_visited_in_the_plane(spark, monkeypatch):
    """Sends of rows to other blocks: a few a row among 32 blocks."""
    sizes = {}
    stage = N.stage_table

    def counted(df, name):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(N, "stage_table", counted)
    x = np.random.default_rng(4).normal(size=(1600, 2))
    N.nearest(table(spark, x), 5, len(x), 2, 50).count()
    assert sizes["visits"] < 6 * len(x)


def test_sends_do_not_grow_with_the_number_of_blocks(spark, monkeypatch):
    """Where all distances are alike, a row meets every block, but is sent once to each host."""
    sizes = {}
    stage = N.stage_table

    def counted(df, name):
        out = stage(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(N, "stage_table", counted)
    x = np.random.default_rng(5).normal(size=(800, 32))
    got = {r.rid: [p.rid for p in r.near] for r in N.nearest(table(spark, x), 5, len(x), 32, 10).collect()}
    assert got == brute(x, 5) and sizes["visits"] <= 16 * len(x)


def test_rows_that_share_an_id_lose_no_neighbour():
    x = np.array([[0.0], [0.0], [1.0], [2.0], [3.0]])
    rid = np.array([7, 7, 1, 2, 3])
    met = list(N.closest(x, rid, np.full(5, np.inf), x, rid, 2))
    assert [at.tolist() for at, _ in met[:2]] == [[2, 3], [2, 3]]


def test_copies_do_not_overfill_a_block(spark):
    x = np.r_[np.tile([1.0, 2.0], (900, 1)), np.c_[np.arange(100.0), np.ones(100)]]
    sizes = [r["count"] for r in N.blocked(table(spark, x), 50, len(x), 2).groupBy("cell", "part").count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 150


def test_new_rows_do_not_depend_on_blocks(spark):
    r = np.random.default_rng(8)
    rows = [(f"a{i}", r.normal(size=3).tolist(), 0.0) for i in range(300)] + [(f"b{i}", r.normal(size=3).tolist(), 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "key string, features array<double>, y double")
    made = [
        sorted(tuple(p.features) for p in Z.smote(df.repartition(parts), "key", "features", "y", block=block).where("key IS NULL").collect())
        for parts, block in ((1, 5000), (6, 20))
    ]
    assert len(made[0]) == 220 and made[0] == made[1]
