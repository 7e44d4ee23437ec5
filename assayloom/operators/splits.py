"""Deterministic splits and folds from hashes of the key.

Every assignment depends on (seed, key) only: it is the same on any cluster, for any row order, and
after any task is run again. Exact sizes come from cut hashes found by counting, so the table itself is
never ranked or moved; each row compares its hash with a handful of cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.operators.ordered import null_safe_join

# Share of the test part, and of validation in the whole table.
TEST_SHARE, VALIDATION_SHARE = 0.2, 0.1
PREFIX = 4


def key_hash(key: str | Column, seed: int | str) -> Column:
    """md5 of "seed|key" as lower-case hex; its text order is the shuffled order of the keys."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), k.cast("string")).cast("binary"))


def _ceil(x: Column) -> Column:
    return F.ceil(x - F.lit(1e-9)).cast("long")


def hash_cuts(hashed: DataFrame, groups: Sequence[str], ranks: list[Column]) -> DataFrame:
    """Per group the hash at each wanted 1-based rank, as columns cut_0, cut_1, ...

    ``ranks`` are expressions over the group size ``n``; rank 0 gives an empty text (before all hashes).
    Rows without a hash (null keys) have no rank and do not count in ``n``. Counts by hash prefix (at most 65,536 per group) locate the prefix that holds a rank; only rows with
    such a prefix are ordered, one prefix at a time. The table of holders is broadcast: it has at most
    len(ranks) rows per group, and groups are classes or repeats.
    """
    groups = list(groups)
    prefix = hashed.where(F.col("_h").isNotNull()).select(*groups, "_h", F.substring("_h", 1, PREFIX).alias("_p"))
    counts = prefix.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("_c"))
    group_window = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    upto = group_window.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    located = counts.withColumns(
        {"_to": F.sum("_c").over(upto), "n": F.sum("_c").over(group_window)}
    ).withColumn("_from", F.col("_to") - F.col("_c"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(ranks)])
    holders = located.withColumn(
        "_wanted", F.filter(wanted, lambda w: (w["r"] > F.col("_from")) & (w["r"] <= F.col("_to")))
    ).where(F.size("_wanted") > 0)
    holders = holders.select(*groups, "_p", "_from", "_wanted")
    place = W.partitionBy(*groups, "_p").orderBy("_h")
    picked = (
        null_safe_join(prefix, F.broadcast(holders), groups + ["_p"])
        .withColumn("_rank", F.row_number().over(place) + F.col("_from"))
        .select(*groups, "_h", "_rank", F.explode("_wanted").alias("_w"))
        .where(F.col("_rank") == F.col("_w.r"))
    )
    by_group = picked.groupBy(*groups).agg(
        *[F.max(F.when(F.col("_w.i") == i, F.col("_h"))).alias(f"cut_{i}") for i in range(len(ranks))]
    )
    return by_group.select(*groups, *[F.coalesce(f"cut_{i}", F.lit("")).alias(f"cut_{i}") for i in range(len(ranks))])


def _test_then_validation(test: float, validation: float) -> list[Column]:
    """Ranks where the test part and the validation part end."""
    n = F.col("n")
    n_test = _ceil(n * F.lit(test))
    n_val = _ceil((n - n_test) * F.lit(validation / (1 - test)))
    return [n_test, n_test + n_val]


def _split_name(h: Column, cut_test: Column, cut_val: Column) -> Column:
    return F.when(h <= cut_test, "test").when(h <= cut_val, "val").otherwise("train")


def split_sizes(n: int, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE) -> tuple[int, int, int]:
    """(train, val, test) row counts of the exact split."""
    n_test = math.ceil(n * test - 1e-9)
    n_val = math.ceil((n - n_test) * (validation / (1 - test)) - 1e-9)
    return n - n_test - n_val, n_val, n_test


def split(
    df: DataFrame, key: str, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE, seed: int = 42, exact: bool = True
) -> DataFrame:
    """Adds ``split`` = train / val / test; keys are unique.

    Exact sizes follow the ceiling rule. ``exact=False`` compares the hash with fixed shares: no counting
    pass, sizes right on average, and old keys keep their part when the table grows. Rows with a null key
    are train and leave the sizes of the others alone.
    """
    hashed = df.withColumn("_h", key_hash(key, seed))
    if not exact:
        share = [f"{min(int(s * 16**8), 16**8 - 1):08x}" for s in (test, test + validation)]
        head = F.substring("_h", 1, 8)
        name = F.when(head < share[0], "test").when(head < share[1], "val").otherwise("train")
        return hashed.withColumn("split", name).drop("_h")
    cuts = hash_cuts(hashed.select("_h"), [], _test_then_validation(test, validation))
    both = cuts.select(F.struct("cut_0", "cut_1")).scalar()
    return hashed.withColumn("split", _split_name(F.col("_h"), both["cut_0"], both["cut_1"])).drop("_h")


def stratified_split(
    df: DataFrame, key: str, label: str, test: float = TEST_SHARE, validation: float = VALIDATION_SHARE, seed: int = 42
) -> DataFrame:
    """As the exact split, inside every class; null is a class. The cut table has one row per class."""
    hashed = df.withColumn("_h", key_hash(key, seed))
    cuts = hash_cuts(hashed.select(label, "_h"), [label], _test_then_validation(test, validation))
    named = null_safe_join(hashed, F.broadcast(cuts), [label], "left")
    return named.withColumn("split", _split_name(F.col("_h"), F.col("cut_0"), F.col("cut_1"))).select(*df.columns, "split")


def repeated_kfold(
    df: DataFrame, key: str, k: int = 5, repeats: int = 3, seed: int = 42, label: str | None = None
) -> DataFrame:
    """One row per (row, repeat) with ``fold`` in 0..k-1; with ``label`` the folds are cut inside classes.

    The first n mod k folds hold one row more than the others. Null labels are a class; rows with a null key
    are in fold 0 and do not count in n.
    """
    columns = [F.struct(F.lit(r).alias("repeat"), key_hash(key, f"{seed}|{r}").alias("_h")) for r in range(repeats)]
    hashed = df.select("*", F.inline(F.array(*columns)))
    groups = ["repeat"] if label is None else ["repeat", label]
    n = F.col("n")
    ends = [(F.lit(i) * F.floor(n / k) + F.least(F.lit(i), n % k)).cast("long") for i in range(1, k)]
    cuts = hash_cuts(hashed.select(*groups, "_h"), groups, ends)
    fold = sum((F.col("_h") > F.col(f"cut_{i}")).cast("int") for i in range(k - 1))
    fold = F.coalesce(fold, F.lit(0))
    return null_safe_join(hashed, F.broadcast(cuts), groups, "left").withColumn("fold", fold).select(*df.columns, "repeat", "fold")


def repeated_stratified_kfold(
    df: DataFrame, key: str, label: str, k: int = 5, repeats: int = 3, seed: int = 42
) -> DataFrame:
    return repeated_kfold(df, key, k, repeats, seed, label)


def fold_sides(folds: DataFrame, k: int = 5) -> DataFrame:
    """One row per (row, repeat, held-out fold) with ``side`` = train or val."""
    held = F.explode(F.array(*[F.lit(i) for i in range(k)])).alias("held_out")
    return folds.select("*", held).withColumn("side", F.when(F.col("fold") == F.col("held_out"), "val").otherwise("train"))


def balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Class weights n / (classes * n_class) over labelled rows; a null label has a null weight."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.struct(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    weight = total["n"] / (total["k"] * F.col("_c"))
    return df.join(F.broadcast(counts.select(label, weight.alias(name))), label, "left")
