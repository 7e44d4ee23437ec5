import hashlib

import pytest
from pyspark.sql import functions as F

from assayloom.operators import splits as S


def test_published_sizes(spark):
    assert S.split_sizes(10661) == (7462, 1066, 2133)
    counts = {r.split: r["count"] for r in S.split(spark.range(10661), "id").groupBy("split").count().collect()}
    assert counts == {"train": 7462, "val": 1066, "test": 2133}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100])
def test_small_tables(spark, n):
    rows = S.split(spark.range(n), "id").collect()
    train, val, test = S.split_sizes(n)
    got = [sum(r.split == s for r in rows) for s in ("train", "val", "test")]
    assert got == [train, val, test] and len({r.id for r in rows}) == n


def test_split_ignores_partitioning_and_order(spark):
    one = {r.id: r.split for r in S.split(spark.range(500).repartition(17), "id").collect()}
    two = {r.id: r.split for r in S.split(spark.range(500).orderBy(F.desc("id")).coalesce(1), "id").collect()}
    assert one == two


def test_hash_split_is_stable_under_growth(spark):
    small = {r.id: r.split for r in S.split(spark.range(300), "id", exact=False).collect()}
    large = {r.id: r.split for r in S.split(spark.range(3000), "id", exact=False).collect()}
    assert all(large[k] == v for k, v in small.items())
    share = sum(v == "test" for v in large.values()) / 3000
    assert 0.17 < share < 0.23


def test_stratified_sizes(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int"))
    rows = S.stratified_split(df, "id", "y").groupBy("y", "split").count().collect()
    got = {(r.y, r.split): r["count"] for r in rows}
    for y, n in ((0, 900), (1, 100)):
        train, val, test = S.split_sizes(n)
        assert (got[(y, "train")], got[(y, "val")], got[(y, "test")]) == (train, val, test)


def test_folds_against_plain_python(spark):
    n, k = 103, 5
    rows = S.repeated_kfold(spark.range(n), "id", k, 2).collect()
    for repeat in (0, 1):
        order = sorted(range(n), key=lambda i: hashlib.md5(f"42|{repeat}|{i}".encode()).hexdigest())
        sizes = [n // k + (i < n % k) for i in range(k)]
        want, at = {}, 0
        for fold, size in enumerate(sizes):
            want.update({key: fold for key in order[at : at + size]})
            at += size
        assert {r.id: r.fold for r in rows if r.repeat == repeat} == want


def test_fewer_rows_than_folds(spark):
    rows = S.repeated_kfold(spark.range(3), "id", 5, 1).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2]


def test_stratified_folds_balance_classes(spark):
    df = spark.range(200).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    rows = S.repeated_stratified_kfold(df, "id", "y").groupBy("repeat", "fold", "y").count().collect()
    assert {r["count"] for r in rows if r.y == 1} == {10} and {r["count"] for r in rows if r.y == 0} == {30}


def test_fold_sides_are_disjoint_and_complete(spark):
    sides = S.fold_sides(S.repeated_kfold(spark.range(50), "id", 5, 1)).collect()
    for held in range(5):
        val = {r.id for r in sides if r.held_out == held and r.side == "val"}
        train = {r.id for r in sides if r.held_out == held and r.side == "train"}
        assert not val & train and len(val | train) == 50


def test_no_shuffle_of_the_table(spark):
    """The exact split compares each row with two scalars: the table's own branch has no exchange."""
    df = spark.range(1000).withColumn("payload", F.lit("x"))
    plan = S.split(df, "id")._jdf.queryExecution().executedPlan().toString()
    main = plan.split("Subquery")[0]
    assert "Exchange" not in main
