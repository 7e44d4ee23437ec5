"""Minority over-sampling by interpolation between neighbours."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.neighbours import BLOCK_ROWS, nearest
from assayloom.operators.splits import hash_cuts, key_hash
from assayloom.session import stage_table

# Imbalance from which rows are added, and neighbours considered.
MIN_RATIO, NEIGHBOURS = 2.0, 5


def _draws(batches: Iterator[pd.DataFrame], seed: int) -> Iterator[pd.DataFrame]:
    """(v, other, gap) of every new row: a neighbour and how far to go towards it, drawn from the row's key."""
    for batch in batches:
        out = []
        for key, v, near, n in zip(batch["k"], batch["v"], batch["near"], batch["n_new"]):
            draw = np.random.default_rng(zlib.crc32(f"{seed}|{key}".encode()))
            places = draw.integers(0, len(near), n)
            out += [(v, near[p]["rid"], gap) for p, gap in zip(places, draw.random(n))]
        yield pd.DataFrame(out, columns=["v", "other", "gap"])


def smote(
    df: DataFrame, key: str, vec: str, label: str, seed: int = 42, neighbours: int = NEIGHBOURS,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """(key, vec, label) with synthetic minority rows (null key) up to the majority count.

    Nothing is added unless there are two classes, their ratio exceeds 2 and the minority has two rows.
    Neighbours are the nearest rows of the whole minority at every ``block`` size (see ``neighbours.py``), ties by
    key and vector; copies of a row are neighbours of it.
    """
    rows = df.select(F.col(key).cast("string").alias("k"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("double").alias("y"))
    original = rows.select(F.col("k").alias(key), F.col("v").alias(vec), F.col("y").alias(label))
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if len(counts) != 2:
        return original
    small, large = sorted(counts, key=lambda c: (counts[c], c))
    k = min(neighbours, counts[small] - 1)
    if counts[large] / counts[small] <= MIN_RATIO or k < 1:
        return original

    missing = counts[large] - counts[small]
    each, extra = divmod(missing, counts[small])
    minority = rows.where(F.col("y") == small).withColumn("_h", key_hash("k", seed))
    n_new = F.lit(each)
    if extra:
        cut = hash_cuts(minority.select("_h"), [], [F.lit(extra).cast("long")]).select("cut_0").scalar()
        n_new = n_new + F.coalesce(F.col("_h") <= cut, F.lit(False)).cast("int")
    # Written once: row numbers must not change when a task runs again.
    minority = stage_table(
        minority.select("k", "v", n_new.cast("int").alias("n_new"), F.xxhash64("k", "v").alias("h"), F.monotonically_increasing_id().alias("rid")),
        "minority",
    )
    width = len(minority.select("v").first().v)
    near = nearest(minority, k, counts[small], width, block)
    drawn = minority.where("n_new > 0").select("rid", "k", "v", "n_new").join(near, "rid").select("k", "v", "n_new", "near")
    drawn = drawn.mapInPandas(lambda batches: _draws(batches, seed), "v array<double>, other bigint, gap double")
    others = minority.select(F.col("rid").alias("other"), F.col("v").alias("w"))
    made = drawn.join(others, "other").select(F.zip_with("v", "w", lambda a, b: a + F.col("gap") * (b - a)).alias("v"))

    synthetic = made.select(F.lit(None).cast("string").alias(key), F.col("v").alias(vec), F.lit(float(small)).alias(label))
    return original.unionByName(synthetic)
