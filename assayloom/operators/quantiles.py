"""Exact percentiles of all features of a vector column, without unfolding it.

A double's bits, read as an ordered whole number, are four digits of 16 bits. Every pass over the whole vectors
counts one digit of those entries that begin like a wanted rank, so the first pass counts all entries by their
leading digit and the later ones a narrowing bracket. Counts are (feature, beginning, digit) rows that tasks shrink
before the shuffle; no entry of the table is moved or ordered, and a group has at most 65,536 rows. The driver holds
two ranks per feature and percentile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.operators.correlation import vector_matrix

DIGIT, DIGITS, ROWS = 16, 4, 4096
_COUNTS = "idx int, start long, digit int, n long"


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles; both zeros are one."""
    bits = (x + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits)


def from_ordered_bits(key: int) -> float:
    return float(np.array([key if key >= 0 else key ^ (2**63 - 1)], np.int64).view(np.float64)[0])


def _digit_counts(df: DataFrame, vec: str, width: int, level: int, starts: dict[int, list[int]] | None) -> DataFrame:
    """Entries by feature, beginning and next digit; at the first digit all entries, later those with a wanted beginning."""
    low = 64 - DIGIT * (level + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = vector_matrix(batch.column(0).slice(at, ROWS), width, finite=False)
                found = []
                for f in range(width) if starts is None else starts:
                    column = x[:, f]
                    head, n = np.unique(ordered_bits(column[~np.isnan(column)]) >> np.int64(low), return_counts=True)
                    if starts is not None:
                        wanted = np.isin(head >> np.int64(DIGIT), starts[f])
                        head, n = head[wanted], n[wanted]
                    found.append((np.full(len(head), f, np.int32), head, n))
                idx, head, n = (np.concatenate(parts) for parts in zip(*found))
                first = starts is None
                start = np.zeros(len(head), np.int64) if first else head >> np.int64(DIGIT)
                digit = (head if first else head & np.int64(2**DIGIT - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(start), pa.array(digit), pa.array(n.astype(np.int64))], names=["idx", "start", "digit", "n"])

    rows = df.select(F.col(vec).cast("array<double>").alias(vec))
    return rows.mapInArrow(run, _COUNTS).groupBy("idx", "start", "digit").agg(F.sum("n").alias("n"))


def vector_percentiles(df: DataFrame, vec: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(idx, names...): linearly interpolated percentiles of every place of an array column.

    Null and NaN entries, null rows and places beyond a row's end do not count; infinite values are ordered first or
    last. A place without any value has no row, an empty table has none at all.
    """
    spark, shape = df.sparkSession, ", ".join(["idx int", *[f"{n} double" for n in names]])
    width = df.agg(F.max(F.size(vec))).first()[0] or 0
    if width <= 0:
        return spark.createDataFrame([], shape)
    counts = _digit_counts(df, vec, width, 0, None)
    totals: dict[int, int] = {}
    wanted: list[tuple[int, int, int, int]] = []  # feature, rank, beginning, rank inside of it
    for level in range(DIGITS):
        place = W.partitionBy("idx", "start").orderBy("digit")
        bins = counts.select("idx", "start", "digit", F.sum("n").over(place).alias("upto"), "n")
        if level == 0:
            bins = bins.withColumn("total", F.sum("n").over(W.partitionBy("idx")))
            at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
            ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(a + 1e-9), F.least(F.floor(a + 1e-9) + 1, F.col("total") - 1)) for a in at])))
            asked = bins.withColumn("rank", F.explode(ranks)).withColumn("inside", F.col("rank"))
        else:
            targets = spark.createDataFrame(wanted, "idx int, rank long, start long, inside long")  # two per feature and percentile
            asked = bins.join(F.broadcast(targets), ["idx", "start"]).withColumn("total", F.lit(0).cast("long"))
        held = asked.where((F.col("inside") < F.col("upto")) & (F.col("inside") >= F.col("upto") - F.col("n")))
        wanted = []
        for r in held.collect():
            totals.setdefault(r.idx, r.total)
            head = r.digit if level == 0 else (r.start << DIGIT) | r.digit
            wanted.append((r.idx, r.rank, head, r.inside - (r.upto - r.n)))
        if not wanted:
            return spark.createDataFrame([], shape)
        if level + 1 < DIGITS:
            starts: dict[int, list[int]] = {}
            for f, _, head, _ in wanted:
                starts.setdefault(f, []).append(head)
            counts = _digit_counts(df, vec, width, level + 1, starts)
    values = {(f, rank): from_ordered_bits(key) for f, rank, key, _ in wanted}
    out = []
    for f, total in sorted(totals.items()):
        row = [f]
        for p in probs:
            at = (total - 1) * float(p)
            lo = math.floor(at + 1e-9)
            a, b, part = values[f, lo], values[f, min(lo + 1, total - 1)], max(at - lo, 0.0)
            row.append(a if part == 0 or a == b else a + part * (b - a))
        out.append(tuple(row))
    return spark.createDataFrame(out, shape)
