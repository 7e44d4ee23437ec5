"""Pair-wise correlations of features with gaps.

For a pair of features the rows count in which *both* values are present, so no row is dropped for a gap
elsewhere. With the present values X (gaps 0, shifted by each feature's mean) and the mask M, four products of
matrices hold all that is needed of a pair: M'M (rows), X'M (sums), (X^2)'M (squares) and X'X (products). They
are additive over rows: every task sums them for blocks of features, and blocks are added by their place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def vector_matrix(column: pa.Array, width: int, finite: bool = True) -> np.ndarray:
    """Rows x width with NaN for gaps; short rows and null rows are gaps at the end, and so are infinite entries if ``finite``."""
    offsets = column.offsets.to_numpy()
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.minimum(np.diff(offsets), width), 0)
    out = np.full((len(column), width), np.nan)
    inside = np.arange(width) < sizes[:, None]
    out[inside] = values[(offsets[:-1, None] + np.arange(width))[inside]]
    if finite:
        out[~np.isfinite(out)] = np.nan
    return out


def feature_means(df: DataFrame, vec: str, width: int) -> np.ndarray:
    """Mean of the finite values of each feature (0 without any): one row per task, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), np.zeros(width)
        for batch in batches:
            x = vector_matrix(batch.column(0), width)
            total += np.nansum(x, axis=0)
            n += np.isfinite(x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total), pa.array(n)], names=["idx", "s", "n"])

    out = np.zeros(width)
    sums = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInArrow(run, "idx int, s double, n double").groupBy("idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    for row in sums.where("n > 0").collect():  # one row per feature
        out[row.idx] = row.s / row.n
    return out


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up matrices of equal places; a task holds one per pair of blocks that it was dealt."""
    held: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for a, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            m = np.frombuffer(blob.as_buffer(), np.float64)
            held[a, b] = held[a, b] + m if (a, b) in held else m
    for (a, b), m in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["a", "b", "m"])


def pairwise_correlations(df: DataFrame, vec: str, width: int | None = None, block: int = BLOCK) -> DataFrame:
    """(i, j, n, r) for every pair of places i < j: rows with both values, and their correlation.

    Null, NaN and infinite entries are gaps; ``r`` is null where a value does not vary over the common rows or there are none.
    Blocks of one task are merged in two rounds, so no task sees more than a share of the tasks' matrices.
    """
    if width is None:
        width = df.agg(F.max(F.size(vec))).first()[0] or 0
    width = max(0, width)
    shift, starts = feature_means(df, vec, width), range(0, width, block)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                x = vector_matrix(batch.column(0).slice(at, 4096), width) - shift
                mask = np.isfinite(x).astype(float)
                x = np.nan_to_num(x, nan=0.0)
                for a in starts:
                    xa, ma = x[:, a:a + block], mask[:, a:a + block]
                    for b in range(a, width, block):
                        xb, mb = x[:, b:b + block], mask[:, b:b + block]
                        m = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, (xa**2).T @ mb, ma.T @ (xb**2), xa.T @ xb])
                        held[a, b] = held[a, b] + m if (a, b) in held else m
        for (a, b), m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m.tobytes()], pa.binary())], names=["a", "b", "m"])

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, sa, sb, qa, qb, c = np.frombuffer(blob.as_buffer(), np.float64).reshape(6, min(block, width - a), min(block, width - b))
                with np.errstate(divide="ignore", invalid="ignore"):
                    va, vb = qa - sa**2 / n, qb - sb**2 / n
                    # A spread that is rounding alone counts as none.
                    flat = (va <= 1e-14 * qa) | (vb <= 1e-14 * qb)
                    r = np.where(flat | (n < 2), np.nan, (c - sa * sb / n) / np.sqrt(va * vb))
                i, j = (k.ravel() for k in np.indices(r.shape))
                ahead = a + i < b + j
                r = np.clip(r.ravel()[ahead], -1, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array((a + i[ahead]).astype(np.int32)), pa.array((b + j[ahead]).astype(np.int32)), pa.array(n.ravel()[ahead].astype(np.int64)), pa.array(r, mask=np.isnan(r))],
                    names=["i", "j", "n", "r"],
                )

    kind = "a int, b int, m binary"
    parts = df.select(F.col(vec).cast("array<double>").alias(vec)).mapInArrow(moments, kind)
    lanes = F.pmod(F.spark_partition_id(), F.lit(16)).alias("lane")
    merged = parts.select("a", "b", "m", lanes).repartition("a", "b", "lane").select("a", "b", "m").mapInArrow(_summed, kind)
    return merged.repartition("a", "b").mapInArrow(_summed, kind).mapInArrow(correlated, "i int, j int, n long, r double")
