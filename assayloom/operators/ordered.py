"""Exact order statistics without putting one group into one task.

Percentiles, ranks and running totals need an order over whole groups, and a group may be most of the
table. Values are therefore cut by fixed monotone functions, first into bins of about 0.02 % of their
magnitude and then into 4,096 cells per bin, so that

* equal values are counted together before anything is moved,
* the running total over the bins of a group, and over the cells of a bin, touches few rows, and
* only distinct values of one cell (about 6e-8 of the magnitude) are ever ordered together.

Bin and cell depend on the value alone, so a task that is run again gives the same answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BINS_PER_E = 4096
CELLS = 4096
SMALLEST = 1e-290
# infinite values share the bin and cell of the largest ones and are ordered there
LARGEST = 1.7e308


def _log_bin(value: Column) -> Column:
    """1-based place of the magnitude on a logarithmic scale; 0 for (nearly) nothing."""
    size = F.least(F.abs(value), F.lit(LARGEST))
    place = F.floor((F.log(F.greatest(size, F.lit(SMALLEST))) - F.log(F.lit(SMALLEST))) * F.lit(BINS_PER_E))
    return F.when(size > SMALLEST, place + F.lit(1)).otherwise(F.lit(0))


def value_bin(value: Column) -> Column:
    """Monotone integer bin of a double."""
    return F.when(value < 0, -_log_bin(value)).otherwise(_log_bin(value)).cast("long")


def value_cell(value: Column, bin_: Column) -> Column:
    """Monotone cell of a value inside its bin: linear between the edges of the bin."""
    edge = lambda b: F.exp(b / F.lit(float(BINS_PER_E)) + F.log(F.lit(SMALLEST)))
    low, high = edge(F.abs(bin_) - 1), edge(F.abs(bin_))
    place = F.least(F.greatest(F.floor((F.least(F.abs(value), F.lit(LARGEST)) - low) / (high - low) * CELLS), F.lit(0)), F.lit(CELLS - 1))
    return F.when(value < 0, -place).otherwise(place).cast("int")


def present(value: Column) -> Column:
    """Neither null nor NaN: what the order statistics of this module count."""
    return value.isNotNull() & ~F.isnan(value.cast("double"))


def _by(keys: Sequence[str]):
    return W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))


def _before(name: str, window) -> Column:
    """Running sum over the rows before the current one."""
    return F.coalesce(F.sum(name).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def running_totals(df: DataFrame, keys: Sequence[str], value: str, measures: dict[str, Column]) -> DataFrame:
    """One row per (keys, distinct value): each measure summed there, ``*_before`` over smaller values in
    the group and ``*_total`` over the group. Null and NaN values are left out.

    The input is read once: bins and cells are totals of the per-value counts, whose shuffle is reused.
    """
    keys, names = list(keys), list(measures)
    rows = df.where(present(F.col(value))).select(
        *keys, F.col(value).cast("double").alias(value), *[c.alias(n) for n, c in measures.items()]
    )
    rows = rows.withColumn("_bin", value_bin(F.col(value))).withColumn("_cell", value_cell(F.col(value), F.col("_bin")))
    distinct = rows.groupBy(*keys, "_bin", "_cell", value).agg(*[F.sum(n).alias(n) for n in names])

    sums = distinct.groupBy(*keys, "_bin", "_cell").agg(*[F.sum(n).alias(n) for n in names])
    in_bin = _by([*keys, "_bin"]).orderBy("_cell")
    cells = sums.select(*keys, "_bin", "_cell", *[_before(n, in_bin).alias(f"_c_{n}") for n in names])

    bins = sums.groupBy(*keys, "_bin").agg(*[F.sum(n).alias(n) for n in names])
    in_group = _by(keys).orderBy("_bin")
    bins = bins.select(
        *keys,
        "_bin",
        *[_before(n, in_group).alias(f"_b_{n}") for n in names],
        *[F.sum(n).over(_by(keys)).alias(f"{n}_total") for n in names],
    )
    bases = null_safe_join(cells, bins, [*keys, "_bin"])
    in_cell = _by([*keys, "_bin", "_cell"]).orderBy(value)
    return null_safe_join(distinct, bases, [*keys, "_bin", "_cell"]).select(
        *keys,
        value,
        *names,
        *[(F.col(f"_b_{n}") + F.col(f"_c_{n}") + _before(n, in_cell)).alias(f"{n}_before") for n in names],
        *[f"{n}_total" for n in names],
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on the named keys in which null matches null; keeps the left side's key columns."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(renamed, on, how).select(*left.columns, *([] if how in ("left_anti", "left_semi") else [c for c in right.columns if c not in keys]))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], few_groups: bool = True
) -> DataFrame:
    """Linearly interpolated percentiles per group, exact for any group size. Null and NaN values are left out.

    A first aggregation finds the bins that hold the wanted ranks: at most two per percentile and group.
    Only rows of those bins are counted by value and ordered, cell by cell. With ``few_groups`` (features,
    hot keys) that list of bins is broadcast; it has at most 2 x percentiles rows per group.
    """
    keys = list(keys)
    rows = df.where(present(F.col(value))).select(
        *keys, F.col(value).cast("double").alias("_v"), F.lit(1).cast("long").alias("_n")
    )
    rows = rows.withColumn("_bin", value_bin(F.col("_v")))
    bins = rows.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n"))
    bins = bins.select(
        *keys, "_bin", "_n", _before("_n", _by(keys).orderBy("_bin")).alias("_base"), F.sum("_n").over(_by(keys)).alias("_total")
    )
    at = lambda p: (F.col("_total") - 1) * F.lit(float(p))
    ranks = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.floor(at(p) + F.lit(1e-9)).cast("long").alias("lo"), at(p).alias("at"))
            for i, p in enumerate(probs)
        ]
    )
    first, last = F.col("_base"), F.col("_base") + F.col("_n") - 1
    held = lambda r: (r >= first) & (r <= last)
    wanted = (
        bins.withColumn("_ranks", F.filter(ranks, lambda r: held(r["lo"]) | held(r["lo"] + 1)))
        .where(F.size("_ranks") > 0)
        .select(*keys, "_bin", "_base", "_ranks")
    )
    hits = null_safe_join(rows, F.broadcast(wanted) if few_groups else wanted, [*keys, "_bin"])
    hits = hits.withColumn("_cell", value_cell(F.col("_v"), F.col("_bin"))).groupBy(*keys, "_bin", "_cell", "_v").agg(
        F.sum("_n").alias("_n"), F.any_value("_base").alias("_base"), F.any_value("_ranks").alias("_ranks")
    )
    cells = hits.groupBy(*keys, "_bin", "_cell").agg(F.sum("_n").alias("_n"))
    cells = cells.select(*keys, "_bin", "_cell", _before("_n", _by([*keys, "_bin"]).orderBy("_cell")).alias("_in_bin"))
    in_cell = _by([*keys, "_bin", "_cell"]).orderBy("_v")
    placed = (
        null_safe_join(hits, cells, [*keys, "_bin", "_cell"])
        .withColumn("_from", F.col("_base") + F.col("_in_bin") + _before("_n", in_cell))
        .withColumn("_to", F.col("_from") + F.col("_n") - 1)
        .select(*keys, "_v", "_from", "_to", F.explode("_ranks").alias("_r"))
    )
    here = lambda r: (r >= F.col("_from")) & (r <= F.col("_to"))
    out = []
    for i, name in enumerate(names):
        mine = F.col("_r.i") == i
        lo = F.max(F.when(mine & here(F.col("_r.lo")), F.col("_v")))
        hi = F.max(F.when(mine & here(F.col("_r.lo") + 1), F.col("_v")))
        part = F.max(F.when(mine, F.col("_r.at") - F.col("_r.lo")))
        part = F.greatest(part, F.lit(0.0))
        out.append(F.when((part == 0) | hi.isNull() | (hi == lo), lo).otherwise(lo + part * (hi - lo)).alias(name))
    return placed.groupBy(*keys).agg(*out)


def median_by_key(df: DataFrame, keys: Sequence[str], value: str, name: str, others: Sequence[Column] = ()) -> DataFrame:
    """Exact median per key, with further aggregates of the same rows; a key without any value has a null one.

    All keys take the same way, whatever their size: counts by bin find the bins that hold the middle, and
    only their rows are ordered, cell by cell.
    """
    keys = list(keys)
    medians = exact_percentiles(df, keys, value, [0.5], [name], few_groups=False)
    every = df.groupBy(*keys).agg(*others) if others else df.select(*keys).distinct()
    return null_safe_join(every, medians, keys, "left").select(*keys, name, *[c for c in every.columns if c not in keys])


def small_side(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table marked for broadcast when it has at most ``most`` rows, else the plain table.

    The count stops after ``most`` rows; beyond it the join shuffles and splits skewed keys as usual.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order.

    A min over structs combines map-side, so a hot key shrinks to one row per task before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def first_present(column: str, order: Sequence[str]) -> Column:
    """Aggregate: first non-null value of a column in the given order."""
    return F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.struct(*order))).alias(column)
