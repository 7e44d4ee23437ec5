"""Approximate nearest neighbours by cosine: stable projections, kd-trees, and a chi-square stopping test.

Unit vectors are projected to a few dimensions by a Gaussian matrix. A pair at distance d has a squared
projected distance of d^2 times a chi-square variable of that many degrees of freedom. A search looks at
projected neighbours from near to far, verifies them on the whole vectors, and stops when the next one is so
far in projection that a pair nearer than the k-th found would be missed with a probability of at most
1 - ``CONFIDENCE``.

The upper kd-tree is fitted on a bounded sample of projections; its leaves are cells. Rows go to their cell,
cells are cut into blocks of bounded size, and each block has a kd-tree of its own. A query goes to those
cells that can pass the test, given its k-th distance to the sample, which is an upper bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayloom.llm.rows import quoted
from assayloom.session import stage_table

DIMENSIONS, CONFIDENCE, SEED = 16, 0.98, 7
SAMPLE_ROWS, BLOCK_ROWS, QUERY_ROWS, LEAF_ROWS = 2048, 8192, 1024, 64
MOST_CELLS = 512


def chi_square_cdf(x: float, m: int) -> float:
    """Lower regularised incomplete gamma function of m/2 at x/2, by its series."""
    if x <= 0:
        return 0.0
    a, half = m / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, 40.0 * m
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosine(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines of the original vectors; each row is summed alone, so equal rows have equal cosines."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


def kd_leaves(points: np.ndarray, leaf_rows: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree: medians of the widest dimension, down to ``leaf_rows`` rows."""
    leaves, open_ = [], [np.arange(len(points))]
    while open_:
        rows = open_.pop()
        if len(rows) <= leaf_rows:
            leaves.append(rows)
            continue
        part = points[rows]
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argsort(part[:, widest], kind="stable")
        open_ += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return leaves


class Cells:
    """The upper kd-tree: splits fitted on a sample, ``2 ** depth`` cells with boxes unbounded outwards."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, m = depth, points.shape[1]
        self.dim = np.zeros(2**depth, np.int64)
        self.at = np.zeros(2**depth)
        self.low, self.high = np.full((2**depth, m), -np.inf), np.full((2**depth, m), np.inf)
        todo = [(1, np.arange(len(points)), np.full(m, -np.inf), np.full(m, np.inf))]
        while todo:
            node, rows, low, high = todo.pop()
            if node >= 2**depth:
                self.low[node - 2**depth], self.high[node - 2**depth] = low, high
                continue
            if len(rows):
                part = points[rows]
                self.dim[node] = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
                self.at[node] = np.median(part[:, self.dim[node]])
            d, cut = self.dim[node], self.at[node]
            left, right = high.copy(), low.copy()
            left[d], right[d] = min(high[d], cut), max(low[d], cut)
            under = points[rows, d] <= cut
            todo += [(2 * node, rows[under], low, left), (2 * node + 1, rows[~under], right, high)]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dim[node]] > self.at[node])
        return node - 2**self.depth

    def squared_distance(self, point: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


def _arrays(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec): rows with an id and a finite, non-zero vector; equal rows count once."""
    rows = table.where(quoted(id_col).isNotNull()).select(quoted(id_col).alias("id"), quoted(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0)).distinct()


def usual_length(rows: DataFrame) -> int:
    """The most frequent length of the vectors (the smaller, if as frequent); 0 without rows."""
    sizes = rows.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max_by("d", F.struct("n", -F.col("d")))).first()[0] or 0


def _projection(dimensions: int, width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, dimensions))


def _search(rows: pd.DataFrame, queries: pd.DataFrame, k: int, dimensions: int, factor: float) -> pd.DataFrame:
    """The k nearest rows of one block for each query, by the incremental search with the stopping test."""
    ids, vectors = rows["id"].to_numpy(), _arrays(rows["vec"])
    units = unit(vectors)
    matrix = _projection(dimensions, vectors.shape[1])
    points = units @ matrix
    leaves = kd_leaves(points, LEAF_ROWS)
    low, high = (np.stack([f(points[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
    starts = _arrays(queries["vec"])
    goals = unit(starts)
    seen = goals @ matrix
    out = []
    for name, start, goal, point, bound in zip(queries["id"], starts, goals, seen, queries["bound"]):
        gap = np.maximum(np.maximum(low - point, point - high), 0)
        near = (gap * gap).sum(axis=1)
        order = np.argsort(near, kind="stable")
        best, at, take = np.zeros(0), 0, 1
        found = np.zeros(0, np.int64)
        # The slack is that of rounding: distances of equal vectors may be a little over or under 0.
        while at < len(order) and near[order[at]] <= (max(bound, 0) + 1e-9) * factor:
            chosen = np.concatenate([leaves[i] for i in order[at:at + take]])
            at, take = at + take, 2 * take
            away = points[chosen] - point
            chosen = chosen[((away * away).sum(axis=1) <= (max(bound, 0) + 1e-9) * factor) & (ids[chosen] != name)]
            distance = 2 - 2 * (units[chosen] @ goal)
            close = distance <= bound + 1e-9
            found, best = np.r_[found, chosen[close]], np.r_[best, distance[close]]
            if len(best) >= k:
                bound = min(bound, float(np.partition(best, k - 1)[k - 1]))
                stay = best <= bound + 1e-9
                found, best = found[stay], best[stay]
        scores = cosine(vectors[found], start)
        top = np.lexsort((ids[found], -scores))[:k]
        out += [(name, ids[i], s) for i, s in zip(found[top], scores[top])]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``table`` found for each row of ``queries``.

    The candidates of a query are all rows but those with its own id; queries need not be in ``table``. Ids
    are integers. Ties in the score go to the smaller id. Vectors that are null, zero, or hold null or
    non-finite components take no part, nor do null ids. Vectors and queries whose length is not the usual one
    of ``table`` take no part either. Rows that share an id but not the vector are candidates each; a query that
    has several vectors asks with the smallest. Fewer than k candidates are all returned. Empty tables give no rows.
    """
    spark = table.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = stage_table(valid_vectors(table, id_col, vec_col), "vectors")
    width = usual_length(rows)
    rows = rows.where(F.size("vec") == width)
    asked = valid_vectors(queries, id_col, vec_col).where(F.size("vec") == width).groupBy("id").agg(F.min("vec").alias("vec"))
    asked = stage_table(asked, "vectors")
    total, n_queries = rows.count(), asked.count()
    if not total or not n_queries:
        return empty
    drawn = F.xxhash64(F.lit(SEED), "id")
    sample = rows.where(F.pmod(drawn, F.lit(1 << 20)) < math.ceil(min(1, SAMPLE_ROWS / total) * (1 << 20))).toPandas()  # about SAMPLE_ROWS rows
    factor = chi_square_quantile(confidence, dimensions)
    known = unit(_arrays(sample["vec"])) if len(sample) else np.zeros((0, width))
    known_ids = sample["id"].to_numpy()
    depth = min(MOST_CELLS.bit_length() - 1, max(0, (-(-total // BLOCK_ROWS) - 1).bit_length()))
    cells = Cells(known @ _projection(dimensions, width), depth)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(cell=cells.of(unit(_arrays(batch["vec"])) @ _projection(dimensions, width)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            goals = unit(_arrays(batch["vec"]))
            points = goals @ _projection(dimensions, width)
            lines = []
            for name, vec, goal, point in zip(batch["id"], batch["vec"], goals, points):
                distance = np.sort((2 - 2 * (known @ goal))[known_ids != name])
                bound = float(max(distance[k - 1], 0)) + 1e-9 if len(distance) >= k else 4.0 + 1e-9
                lines += [(name, vec, bound, int(c)) for c in np.flatnonzero(cells.squared_distance(point) <= bound * factor)]
            yield pd.DataFrame(lines, columns=["id", "vec", "bound", "cell"])

    placed = stage_table(rows.mapInPandas(place, "id long, vec array<double>, cell long"), "placed")
    routed = stage_table(asked.mapInPandas(route, "id long, vec array<double>, bound double, cell long"), "routed")
    # Blocks: as many row parts and query parts as keep both sides of a block near their bounds; one row per cell.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("long").alias("row_parts"))
    loads = routed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("long").alias("query_parts"))
    parts = F.broadcast(stage_table(sizes.join(loads, "cell"), "blocks"))  # at most MOST_CELLS rows
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = placed.join(parts, "cell").withColumn("row_part", F.pmod(F.xxhash64("id"), F.col("row_parts"))).withColumn("query_part", every("query_parts"))
    right = routed.join(parts, "cell").withColumn("query_part", F.pmod(F.xxhash64("id"), F.col("query_parts"))).withColumn("row_part", every("row_parts"))
    key = ["cell", "row_part", "query_part"]
    found = left.select(*key, "id", "vec").groupBy(*key).cogroup(right.select(*key, "id", "vec", "bound").groupBy(*key)).applyInPandas(
        lambda block, ask: _search(block, ask, k, dimensions, factor) if len(block) and len(ask) else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}),
        "query_id long, vec_id long, score double",
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
