"""Leaf-wise boosted trees from second-order gradient histograms, aggregated in Spark tasks.

Features are cut into bins once; rows become blocks of bin numbers, labels, weights and margins in a stage table.
For a set of open leaves every task sums gradients and second derivatives by leaf, feature and bin; the sums meet
by groups of features, where the best split of each leaf in the group is found, so only one row per leaf and
group reaches the driver. A tree grows leaf by leaf, always at the leaf with the greatest gain; the leaves that may
come next are looked at in the same job, so a tree takes about as many jobs as it has levels. Margins are
written anew after every few trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.operators.features import unfold
from assayloom.operators.ordered import exact_percentiles
from assayloom.operators.trees import FlatTrees
from assayloom.session import stage_table

BLOCK_ROWS, FEATURE_GROUP, MARGINS_EVERY = 65_536, 16, 10


@dataclass(frozen=True)
class Settings:
    """Rounds, leaves and depth of a tree, learning rate, bins per feature, L1 and L2 on leaf values, least second
    derivative and rows of a leaf, shares of the columns and rows that a tree sees."""

    rounds: int = 300
    leaves: int = 31
    depth: int = 6
    rate: float = 0.05
    bins: int = 64
    l1: float = 0.0
    l2: float = 1.0
    least_hessian: float = 1e-3
    least_rows: int = 1
    columns: float = 0.8
    rows: float = 0.8
    seed: int = 42


@dataclass
class Node:
    depth: int
    g: float
    h: float
    split: tuple | None = None  # (gain, feature, bin, g left, h left)
    kids: tuple[int, int] | None = None


@dataclass
class Tree:
    """Nodes by number; routing goes by ``steps``: node -> (feature, bin, left, right)."""

    nodes: list[Node] = field(default_factory=list)
    steps: dict[int, tuple[int, int, int, int]] = field(default_factory=dict)

    def route(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for node in sorted(self.steps):  # children have greater numbers
            feature, cut, left, right = self.steps[node]
            here = np.flatnonzero(at == node)
            at[here] = np.where(bins[here, feature] <= cut, left, right)
        return at


def soft(g, l1: float):
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0)


def leaf_value(g, h, s: Settings):
    return -soft(g, s.l1) / (h + s.l2)


def gradients(task: str, y: np.ndarray, margin: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if task == "regression":
        return weight * (margin - y), weight
    p = 1 / (1 + np.exp(-margin))
    return weight * (p - y), weight * p * (1 - p)


def best_splits(g: np.ndarray, h: np.ndarray, n: np.ndarray, first: int, s: Settings) -> list[tuple]:
    """Per leaf (gain, feature, bin, g left, h left, g, h) from sums by (leaf, feature, bin); the first on ties."""
    gl, hl, nl = (np.cumsum(x, axis=2) for x in (g, h, n))
    total_g, total_h, total_n = (x[:, :, -1:] for x in (gl, hl, nl))
    score = lambda a, b: soft(a, s.l1) ** 2 / (b + s.l2)
    gain = score(gl, hl) + score(total_g - gl, total_h - hl) - score(total_g, total_h)
    small = (hl < s.least_hessian) | (total_h - hl < s.least_hessian) | (nl < s.least_rows) | (total_n - nl < s.least_rows)
    gain = np.where(small, -math.inf, gain)
    out = []
    for leaf in range(len(g)):
        f, b = np.unravel_index(int(np.argmax(gain[leaf])), gain[leaf].shape)
        out.append((float(gain[leaf, f, b]), first + int(f), int(b), float(gl[leaf, f, b]), float(hl[leaf, f, b]), float(total_g[leaf, 0, 0]), float(total_h[leaf, 0, 0])))
    return out


class LeafwiseBooster:
    """Fits on (x vector, y, optional weight); ``task`` is "classification" (y 0 or 1) or "regression"."""

    def __init__(self, task: str, settings: Settings = Settings(), weight: str | None = None, features: str = "x", label: str = "y"):
        self.task, self.settings, self.weight, self.features, self.label = task, settings, weight, features, label

    def fit(self, df: DataFrame) -> LeafwiseModel:
        s, task = self.settings, self.task
        rows = df.select(vector_to_array(self.features).alias("v"), F.col(self.label).cast("double").alias("y"), (F.col(self.weight).cast("double") if self.weight else F.lit(1.0)).alias("w"))
        rows = rows.where("y IS NOT NULL AND w > 0")
        facts = rows.agg(F.max(F.size("v")).alias("p"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy")).first()
        if not facts.p:
            raise ValueError("no labelled rows with features")
        mean = facts.wy / facts.w
        base = mean if task == "regression" else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
        cuts = bin_cuts(rows, "v", facts.p, s.bins)
        blocks = stage_table(_blocks(rows, cuts, base), "blocks")
        trees, waiting = [], []
        for number in range(s.rounds):
            tree = _grown(blocks, waiting, number, facts.p, s, task)
            if not tree.steps:
                break
            trees.append(tree)
            waiting.append(tree)
            if len(waiting) == MARGINS_EVERY:
                blocks, waiting = stage_table(_moved(blocks, waiting, s), "blocks"), []
        return LeafwiseModel(task, base, flat(trees, cuts, s), self.features, facts.p)


def booster(task: str, options: dict, weight: str | None = None, seed: int = 42) -> LeafwiseBooster:
    """A booster from the option names of the other boosted family, or its own."""
    own = {"maxIter": "rounds", "maxDepth": "depth", "stepSize": "rate", "subsamplingRate": "rows"}
    return LeafwiseBooster(task, Settings(**{own.get(k, k): v for k, v in options.items()}, seed=seed), weight)


def bin_cuts(rows: DataFrame, vec: str, width: int, bins: int) -> list[np.ndarray]:
    """Ascending cut values per feature, at exact quantiles; a value goes to the first cut that is not below it."""
    probs = [i / bins for i in range(1, bins)]
    names = [f"q{i}" for i in range(1, bins)]
    found = {r.idx: [r[n] for n in names] for r in exact_percentiles(unfold(rows, vec), ["idx"], "x", probs, names).collect()}
    return [np.unique([q for q in found.get(i, []) if q is not None]).astype(float) for i in range(width)]


def _blocks(rows: DataFrame, cuts: list[np.ndarray], base: float) -> DataFrame:
    """(block, n, bins, y, w, margin): up to BLOCK_ROWS rows as bytes."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                x = np.stack([np.asarray(v, float) for v in piece.column(0).to_pylist()])
                bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], axis=1).astype(np.uint8)
                y, w = (piece.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                columns = [[(part << 32) + turn], [len(y)], [bins.tobytes()], [y.tobytes()], [w.tobytes()], [np.full(len(y), base).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(columns)], names=["block", "n", "bins", "y", "w", "margin"])
                turn += 1

    return rows.mapInArrow(run, "block long, n long, bins binary, y binary, w binary, margin binary")


def _read(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    y, w, margin = (np.frombuffer(row[c], np.float64) for c in ("y", "w", "margin"))
    return np.frombuffer(row["bins"], np.uint8).reshape(row["n"], -1), y, w, margin


def _values(tree: Tree, s: Settings) -> np.ndarray:
    return s.rate * np.array([leaf_value(n.g, n.h, s) for n in tree.nodes])


def _moved(blocks: DataFrame, trees: list[Tree], s: Settings) -> DataFrame:
    """The blocks with the trees added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for row in batch.to_pylist():
                bins, _, _, margin = _read(row)
                new.append((margin + sum(_values(t, s)[t.route(bins)] for t in trees)).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(new, pa.binary())], names=batch.schema.names)

    return blocks.mapInArrow(run, blocks.schema)


def _looked_at(blocks: DataFrame, before: list[Tree], tree: Tree, leaves: list[int], number: int, width: int, s: Settings, task: str) -> dict[int, tuple]:
    """Best split of each of ``leaves``: sums by task, then by group of features, then one row per leaf and group."""
    columns = np.sort(np.random.default_rng((s.seed, number)).permutation(width)[:max(1, math.ceil(s.columns * width))])
    groups = [columns[i:i + FEATURE_GROUP] for i in range(0, len(columns), FEATURE_GROUP)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((3, len(leaves), len(g), s.bins)) for g in groups]
        place = np.full(len(tree.nodes) + 1, -1)
        place[leaves] = np.arange(len(leaves))
        for batch in batches:
            for row in batch.to_pylist():
                bins, y, w, margin = _read(row)
                if s.rows < 1:
                    # The draw depends on the block and the tree alone, so a task that runs again draws the same.
                    stay = np.random.default_rng((s.seed, number, row["block"])).random(len(y)) < s.rows
                    bins, y, w, margin = bins[stay], y[stay], w[stay], margin[stay]
                for t in before:
                    margin = margin + _values(t, s)[t.route(bins)]
                at = place[tree.route(bins)]
                some = at >= 0
                bins, at = bins[some], at[some]
                g, h = gradients(task, y[some], margin[some], w[some])
                for total, group in zip(held, groups):
                    for j, f in enumerate(group):
                        cell = at * s.bins + bins[:, f]
                        for k, weights in enumerate((g, h, None)):
                            total[k, :, j] += np.bincount(cell, weights, len(leaves) * s.bins).reshape(len(leaves), s.bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(groups)), pa.int32()), pa.array([t.tobytes() for t in held], pa.binary())], names=["grp", "m"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for grp, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                m = np.frombuffer(blob.as_buffer(), np.float64)
                held[grp] = held[grp] + m if grp in held else m
        out = []
        for grp, m in held.items():
            g, h, n = m.reshape(3, len(leaves), len(groups[grp]), s.bins)
            for leaf, found in zip(leaves, best_splits(g, h, n, 0, s)):
                out.append((leaf, found[0], int(groups[grp][found[1]]), *found[2:]))
        kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["leaf", "gain", "feature", "bin", "gl", "hl", "g", "h"])

    parts = blocks.mapInArrow(sums, "grp int, m binary").repartition(len(groups), "grp")
    found = parts.mapInArrow(split, "leaf int, gain double, feature int, bin int, gl double, hl double, g double, h double").collect()
    best: dict[int, tuple] = {}
    for r in sorted(found, key=lambda r: (r.leaf, -r.gain, r.feature, r.bin)):
        best.setdefault(r.leaf, (r.gain, r.feature, r.bin, r.gl, r.hl, r.g, r.h))
    return best


def _grown(blocks: DataFrame, before: list[Tree], number: int, width: int, s: Settings, task: str) -> Tree:
    """One tree, leaf by leaf at the greatest gain. Children are made for every leaf that may be split next."""
    tree = Tree([Node(0, 0.0, 0.0)])
    waiting = [0]
    while waiting:
        for leaf, found in _looked_at(blocks, before, tree, waiting, number, width, s, task).items():
            node = tree.nodes[leaf]
            node.g, node.h = found[5], found[6]
            node.split = found[:5] if found[0] > 0 and node.depth < s.depth else None
        chosen, ready = _chosen(tree, s.leaves)
        # Splits that are taken, and those that the leaf budget left may still reach.
        waiting, left = [], s.leaves - 1 - len(chosen)
        for leaf in ready[:max(0, left)]:
            node = tree.nodes[leaf]
            _, feature, cut, gl, hl = node.split
            node.kids = (len(tree.nodes), len(tree.nodes) + 1)
            tree.nodes += [Node(node.depth + 1, gl, hl), Node(node.depth + 1, node.g - gl, node.h - hl)]
            tree.steps[leaf] = (feature, cut, *node.kids)
            waiting += [k for k in node.kids if tree.nodes[k].depth < s.depth]
    chosen, _ = _chosen(tree, s.leaves)
    return replace(tree, steps={n: tree.steps[n] for n in chosen})


def _chosen(tree: Tree, leaves: int) -> tuple[list[int], list[int]]:
    """(splits in the order that growth takes them, as far as they have children; splits without, by gain)."""
    taken, open_leaves = [], [0]
    while len(taken) < leaves - 1:
        able = [n for n in open_leaves if tree.nodes[n].split]
        if not able:
            break
        top = max(able, key=lambda n: (tree.nodes[n].split[0], -n))
        if tree.nodes[top].kids is None:
            break
        taken.append(top)
        open_leaves.remove(top)
        open_leaves += tree.nodes[top].kids
    ready, todo = [], [0]
    while todo:
        node = tree.nodes[n := todo.pop()]
        todo += node.kids or ()
        if node.split and node.kids is None:
            ready.append(n)
    return taken, sorted(ready, key=lambda n: (-tree.nodes[n].split[0], n))


def flat(trees: list[Tree], cuts: list[np.ndarray], s: Settings) -> FlatTrees:
    """All trees as node arrays with thresholds of the original features; inner nodes have their value as a leaf."""
    roots, left, right, feature, threshold, value = ([] for _ in range(6))
    for tree in trees:
        at = len(left)
        roots.append(at)
        values = _values(tree, s)
        for n in range(len(tree.nodes)):
            f, cut, a, b = tree.steps.get(n, (-1, 0, n, n))
            left.append(at + a)
            right.append(at + b)
            feature.append(f)
            threshold.append(cuts[f][cut] if f >= 0 and cut < len(cuts[f]) else math.inf)
            value.append(values[n])
    kinds = (np.int64, np.int64, np.int64, float, float)
    arrays = [np.array(v, k) for v, k in zip((left, right, feature, threshold, value), kinds)]
    return FlatTrees(np.array(roots, np.int64), np.ones(len(roots)), *arrays)


_NODE, _FACTS = "place long, root boolean, lft long, rgt long, feature long, threshold double, value double", "task string, base double, features string, width int"


def load_leafwise(spark: SparkSession, path: str) -> LeafwiseModel:
    facts = spark.read.schema(_FACTS).parquet(f"{path}/facts").first()
    n = spark.read.schema(_NODE).parquet(f"{path}/nodes").toPandas().sort_values("place")
    arrays = [n[c].to_numpy() for c in ("lft", "rgt", "feature", "threshold", "value")]
    roots = np.flatnonzero(n["root"].to_numpy(bool))
    return LeafwiseModel(facts.task, facts.base, FlatTrees(roots, np.ones(len(roots)), *arrays), facts.features, facts.width)


@dataclass(frozen=True)
class LeafwiseModel:
    """Adds prediction, and for classes probability, to rows with a feature vector."""

    task: str
    base: float
    trees: FlatTrees
    features: str
    width: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.trees.base + self.trees.attribute(x).sum(axis=1)

    @property
    def explained(self) -> FlatTrees:
        """The trees, and the base as one more tree that is a single leaf: attributions of the margin."""
        t, n = self.trees, len(self.trees.left)
        ends = ((t.roots, n), (t.weights, 1.0), (t.left, n), (t.right, n), (t.feature, -1), (t.threshold, math.inf), (t.value, self.base))
        return FlatTrees(*(np.append(values, end) for values, end in ends))

    def save(self, path: str) -> str:
        """Two small tables, one row per node and one row of facts; ``load_leafwise`` reads them."""
        t, spark = self.trees, SparkSession.active()
        roots = set(t.roots.tolist())
        nodes = [(i, i in roots, *(v[i].item() for v in (t.left, t.right, t.feature, t.threshold, t.value))) for i in range(len(t.left))]
        spark.createDataFrame(nodes, _NODE).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.task, float(self.base), self.features, self.width)], _FACTS).write.mode("overwrite").parquet(f"{path}/facts")
        return path

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def score(rows: pd.Series) -> pd.Series:
            return pd.Series(model.margin(np.stack([np.asarray(v, float) for v in rows])) if len(rows) else [], dtype=float)

        out = df.withColumn("_margin", score(vector_to_array(self.features)))
        if self.task == "regression":
            return out.withColumnRenamed("_margin", "prediction")
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (F.col("_margin") > 0).cast("double")).drop("_margin")
