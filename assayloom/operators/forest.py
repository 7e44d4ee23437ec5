"""Random forests of two classes that never lie whole on the driver: trees are grown, kept and applied in tasks.

Features are cut into bins once, and rows become blocks of bin numbers. As long as a node has more rows than one task
should hold, tasks sum weights by node, feature and bin, and one row per node reaches the driver. Smaller nodes get
their rows, and one task grows all that is below. A tree is a row of a stage table. To apply a forest, rows are dealt
into blocks, and all trees pass by each block one after the other.

Trees are grown as Spark's are: Gini impurity, counts of a Poisson draw with mean 1 per tree, a new draw of features at
each node, and leaves of one parent that predict the same class become one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.operators.correlation import vector_matrix
from assayloom.operators.quantiles import vector_percentiles
from assayloom.operators.trees import FlatTrees
from assayloom.session import stage_table

#: Draws of a node at most, for its rows to go to one task; entries of feature vectors that a task holds while trees pass;
#: rows of a block of bin numbers.
NODE_ROWS, HELD_ENTRIES, BLOCK_ROWS = 131_072, 8_388_608, 4096
_BLOCKS = "block long, n long, bins binary, y binary, w binary"
_PARTS = "tree int, node int, block long, bins binary, y binary, n binary, w binary"
_TREES = "tree int, lft binary, feature binary, bin binary, value binary, gain binary"
_KINDS = {"lft": np.int32, "feature": np.int32, "bin": np.uint8, "value": np.float64, "gain": np.float64}


@dataclass
class Nodes:
    """Nodes of one tree, the root first; children lie side by side behind their parent, leaves have no feature.

    ``gain`` is the impurity that a split takes away, times the weight of the node.
    """

    lft: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    bin: np.ndarray = field(default_factory=lambda: np.zeros(1, np.uint8))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.lft, self.feature, self.bin, self.value, self.gain

    def route(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(rows := rows[self.feature[at[rows]] >= 0]):
            node = at[rows]
            at[rows] = self.lft[node] + (bins[rows, self.feature[node]] > self.bin[node])
        return at

    def split(self, node: int, feature: int, cut: int, gain: float, values: tuple[float, float]) -> int:
        """Makes two leaves under ``node``; gives the first one's place."""
        first = len(self.lft)
        self.lft[node], self.feature[node], self.bin[node], self.gain[node] = first, feature, cut, gain
        new = (0, -1, 0, values, 0.0)
        self.lft, self.feature, self.bin, self.value, self.gain = (np.append(a, np.full(2, v, a.dtype)) for a, v in zip(self.parts(), new))
        return first

    def hang(self, node: int, below: Nodes) -> None:
        """Puts a tree in the place of a leaf."""
        first = len(self.lft)
        moved = [below.lft + (first - 1), *below.parts()[1:]]
        for a, b in zip(self.parts(), moved):
            a[node] = b[0]
        self.lft, self.feature, self.bin, self.value, self.gain = (np.append(a, b[1:].astype(a.dtype)) for a, b in zip(self.parts(), moved))

    def pruned(self) -> Nodes:
        """Without splits that lead to leaves of the same class."""
        levels = [np.zeros(1, np.int64)]
        while len(inner := levels[-1][self.feature[levels[-1]] >= 0]):
            levels.append((self.lft[inner][:, None] + np.arange(2)).ravel())
        feature, gain, one = self.feature.copy(), self.gain.copy(), self.value > 0.5
        for level in reversed(levels):
            inner = level[feature[level] >= 0]
            a = self.lft[inner]
            same = inner[(feature[a] < 0) & (feature[a + 1] < 0) & (one[a] == one[a + 1])]
            feature[same], gain[same] = -1, 0.0
        kept = np.zeros(len(feature), bool)
        kept[0] = True
        for level in levels:
            inner = level[kept[level] & (feature[level] >= 0)]
            kept[self.lft[inner]] = kept[self.lft[inner] + 1] = True
        place = np.cumsum(kept) - 1
        lft = np.where(feature >= 0, place[self.lft], 0).astype(np.int32)
        return Nodes(*(a[kept] for a in (lft, feature, self.bin, self.value, gain)))


def splits(total: np.ndarray, one: np.ndarray, drawn: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) of the best cut of each row of sums by bin: weight, weight of class 1, rows drawn."""
    gini = lambda n, k: 2 * k * (n - k) / np.maximum(n, 1e-300) ** 2
    n, k, c = (np.cumsum(x, axis=-1) for x in (total, one, drawn))
    whole, ones, rows = (x[..., -1:] for x in (n, k, c))
    lower = (n * gini(n, k) + (whole - n) * gini(whole - n, ones - k)) / np.maximum(whole, 1e-300)
    gain = np.where((c >= least) & (rows - c >= least) & (n > 0) & (whole - n > 0), gini(whole, ones) - lower, 0.0)
    cut = np.argmax(gain, axis=-1)
    return np.take_along_axis(gain, cut[..., None], -1)[..., 0], cut


def grown(bins: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, s: TaskForest, depth: int, draw: np.random.Generator) -> Nodes:
    """All nodes from here on, level by level; ``n`` and ``w`` are a row's draws and weight."""
    made: list[tuple[np.ndarray, ...]] = []
    at, m, first, width = np.zeros(len(y), np.int64), 1, 0, bins.shape[1]
    ones, size, per_node = w * y, s.maxBins, s.features_of_node(width)
    while m:
        whole, one = np.bincount(at, w, m), np.bincount(at, ones, m)
        gain, feature, cut = np.zeros(m), np.full(m, -1, np.int32), np.zeros(m, np.uint8)
        mixed = (one > 0) & (one < whole)
        if depth < s.maxDepth and mixed.any():
            rows = mixed[at]
            place = np.cumsum(mixed) - 1
            bins, y, n, w, ones, at = (a[rows] for a in (bins, y, n, w, ones, at))
            near, k = place[at], int(mixed.sum())
            of_node = np.sort(np.argsort(draw.random((k, width)), axis=1)[:, :per_node], axis=1)
            best, f_best, c_best = np.zeros(k), np.full(k, -1, np.int32), np.zeros(k, np.uint8)
            for j in range(per_node):
                cell = near * size + bins[np.arange(len(near)), of_node[near, j]]
                sums = [np.bincount(cell, x, k * size).reshape(k, size) for x in ((w, ones, n) if s.weightCol else (w, ones))]
                g, c = splits(*sums, *([] if s.weightCol else sums[:1]), s.minInstancesPerNode)
                better = g > best
                best[better], f_best[better], c_best[better] = g[better], of_node[better, j], c[better]
            gain[mixed], feature[mixed], cut[mixed] = best * whole[mixed], f_best, c_best
        open_ = feature >= 0
        rank = np.cumsum(open_) - 1
        made.append((np.where(open_, first + m + 2 * rank, 0).astype(np.int32), feature, cut, one / whole, gain))
        stay = open_[at]
        bins, y, n, w, ones, at = (a[stay] for a in (bins, y, n, w, ones, at))
        at = 2 * rank[at] + (bins[np.arange(len(at)), feature[at]] > cut[at])
        first, m, depth = first + m, 2 * int(open_.sum()), depth + 1
    return Nodes(*(np.concatenate(x) for x in zip(*made)))


@dataclass(frozen=True)
class TaskForest:
    """Fits on (x vector, y 0 or 1, optional weight). Options are those of Spark's forest, with its names."""

    numTrees: int = 20
    maxDepth: int = 5
    maxBins: int = 32
    featureSubsetStrategy: str = "auto"
    minInstancesPerNode: int = 1
    bootstrap: bool = True
    seed: int = 42
    featuresCol: str = "x"
    labelCol: str = "y"
    weightCol: str | None = None
    node_rows: int = NODE_ROWS

    def __post_init__(self):
        if not 2 <= self.maxBins <= 256:
            raise ValueError("a bin number is a byte: 2 to 256 bins")

    def features_of_node(self, width: int) -> int:
        way = self.featureSubsetStrategy if self.featureSubsetStrategy != "auto" else "sqrt" if self.numTrees > 1 else "all"
        named = {"all": width, "sqrt": math.ceil(math.sqrt(width)), "log2": max(1, math.ceil(math.log2(width))), "onethird": math.ceil(width / 3)}
        return named[way] if way in named else min(width, int(way)) if way.isdigit() else math.ceil(float(way) * width)

    def drawn(self, tree: int, block: int, n: int) -> np.ndarray:
        """How often a tree sees each row of a block; the same whenever it is asked."""
        if not self.bootstrap:
            return np.ones(n)
        return np.random.default_rng((self.seed, tree, block)).poisson(1.0, n).astype(float)

    def fit(self, df: DataFrame) -> TaskForestModel | RandomForestClassificationModel:
        """The fitted forest; one of more than two classes is fitted by Spark's own."""
        w = F.col(self.weightCol).cast("double") if self.weightCol else F.lit(1.0)
        rows = df.select(vector_to_array(self.featuresCol).alias("v"), F.col(self.labelCol).cast("double").alias("y"), w.alias("w"))
        size = F.size("v")
        gap = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
        odd = F.coalesce(~F.col("y").isin(0.0, 1.0) | (F.col("w") < 0) | F.isnan("w") | (F.col("w") == math.inf) | gap, F.lit(True))
        facts = rows.agg(F.max(size).alias("p"), F.min(size).alias("least"), F.count(F.lit(1)).alias("n"), F.count_if(odd).alias("odd"), F.sum("w").alias("w"), F.max("y").alias("most")).first()
        if facts.most is not None and facts.most > 1:
            own = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "node_rows" and getattr(self, f.name) is not None}
            return RandomForestClassifier(**own).fit(df)
        if not facts.n or not facts.w or facts.p < 1 or facts.least != facts.p or facts.odd:
            raise ValueError(f"a forest needs rows with finite features, all as many, and labels 0 or 1; {facts.odd} of {facts.n} rows have others")
        cuts = bin_cuts(rows, "v", facts.p, self.maxBins)
        blocks = stage_table(_blocks(rows, cuts).repartition(_tasks(df), "block"), "forest-blocks")
        tops, parts = _tops(blocks, facts.n, facts.p, self)
        below = _dealt(blocks, tops, parts, facts.p, self)
        trees = stage_table(_whole(df.sparkSession, below, tops, parts, facts.p, self), "forest")
        return TaskForestModel(trees, cuts, self.featuresCol)


def bin_cuts(rows: DataFrame, vec: str, width: int, bins: int) -> list[np.ndarray]:
    """Ascending cuts per feature; a value goes to the first cut that is not below it. Few values are cut between each
    other, many at exact quantiles."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(0)] * width
        for batch in batches:
            x = vector_matrix(batch.column(0), width, finite=False)
            for f in range(width):
                if len(seen[f]) <= bins:
                    seen[f] = np.unique(np.append(seen[f], x[~np.isnan(x[:, f]), f]))[:bins + 1]
        idx = np.repeat(np.arange(width, dtype=np.int32), [len(v) for v in seen])
        yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(np.concatenate(seen))], names=["idx", "x"])

    found = rows.select(vec).mapInArrow(few, "idx int, x double").groupBy("idx").agg(F.slice(F.array_sort(F.collect_set("x")), 1, bins + 1).alias("x"))
    cuts: list[np.ndarray | None] = [np.zeros(0)] * width
    for r in found.collect():
        x = np.unique(np.array(r.x, float))
        cuts[r.idx] = (x[:-1] + x[1:]) / 2 if len(x) <= bins else None
    if any(c is None for c in cuts):
        names = [f"q{i}" for i in range(1, bins)]
        for r in vector_percentiles(rows, vec, [i / bins for i in range(1, bins)], names).collect():
            if cuts[r.idx] is None:
                cuts[r.idx] = np.unique([r[n] for n in names]).astype(float)
    return cuts


def _tasks(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers; a missing value is in the last bin."""
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _record(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    pairs = [p.split() for p in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[k]) for n, k in pairs], names=[n for n, _ in pairs])


def _blocks(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """(block, n, bins, y, w): up to BLOCK_ROWS rows as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                codes = _codes(vector_matrix(piece.column(0), len(cuts), finite=False), cuts)
                y, w = (piece.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (1, 2))
                yield _record({"block": [(part << 32) + turn], "n": [len(y)], "bins": [codes.tobytes()], "y": [y.astype(np.uint8).tobytes()], "w": [w.tobytes()]}, _BLOCKS)
                turn += 1

    return rows.mapInArrow(run, _BLOCKS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, n, bins, y, w = (batch.column(c)[i] for c in range(5))
            yield block.as_py(), np.frombuffer(bins.as_buffer(), np.uint8).reshape(n.as_py(), -1), np.frombuffer(y.as_buffer(), np.uint8), np.frombuffer(w.as_buffer(), np.float64)


def _features(s: TaskForest, tree: int, node: int, width: int) -> np.ndarray:
    return np.sort(np.random.default_rng((s.seed, tree, node, 1)).permutation(width)[:s.features_of_node(width)])


def _best(blocks: DataFrame, tops: list[Nodes], wanted: list[tuple[int, int]], width: int, s: TaskForest) -> DataFrame:
    """(tree, node, gain, feature, bin, and weight, weight of class 1 and draws of the node and its left side)."""
    by_tree: dict[int, list[int]] = {}
    for tree, node in wanted:
        by_tree.setdefault(tree, []).append(node)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for block, bins, y, w in _read(batches):
            for tree, nodes in by_tree.items():
                n, at = s.drawn(tree, block, len(y)), tops[tree].route(bins)
                for node in nodes:
                    here = np.flatnonzero((at == node) & (n > 0) & (w > 0))
                    features = _features(s, tree, node, width)
                    cell = (np.arange(len(features)) * s.maxBins + bins[here][:, features]).ravel()
                    weight, drawn = n[here] * w[here], n[here]
                    found = np.stack([np.bincount(cell, np.repeat(v, len(features)), len(features) * s.maxBins) for v in (weight, weight * y[here], drawn)])
                    held[tree, node] = held[tree, node] + found if (tree, node) in held else found
        for (tree, node), found in held.items():
            yield _record({"tree": [tree], "node": [node], "m": [found.tobytes()]}, "tree int, node int, m binary")

    shape = "tree int, node int, gain double, feature int, bin int, w double, w1 double, n double, wl double, wl1 double, nl double"

    def best(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m.as_buffer(), np.float64) for m in table["m"].combine_chunks())
        whole = total.reshape(3, -1, s.maxBins)
        gain, cut = splits(*whole, s.minInstancesPerNode)
        f = int(np.argmax(gain))
        tree, node = (int(k.as_py()) for k in key)
        at_node, left = whole[:, 0].sum(axis=1), whole[:, f, :cut[f] + 1].sum(axis=1)
        got = [tree, node, float(gain[f]), int(_features(s, tree, node, width)[f]), int(cut[f]), *at_node.tolist(), *left.tolist()]
        return pa.Table.from_batches([_record({p.split()[0]: [v] for p, v in zip(shape.split(", "), got)}, shape)])

    return blocks.mapInArrow(sums, "tree int, node int, m binary").groupBy("tree", "node").applyInArrow(best, shape)


def _tops(blocks: DataFrame, n: int, width: int, s: TaskForest) -> tuple[list[Nodes], dict[int, dict[int, int]]]:
    """The upper part of every tree, and by tree the nodes, with their depth, below which a task goes on."""
    tops = [Nodes() for _ in range(s.numTrees)]
    parts: dict[int, dict[int, int]] = {t: {0: 0} for t in range(s.numTrees)}
    wanted = [(t, 0) for t in range(s.numTrees)] if n > s.node_rows else []
    while wanted:
        further = []
        for r in _best(blocks, tops, wanted, width, s).collect():
            top, depth = tops[r.tree], parts[r.tree].pop(r.node)
            top.value[r.node] = r.w1 / r.w if r.w else 0.0
            if r.gain <= 0 or depth == s.maxDepth:
                continue
            sides = ((r.wl, r.wl1, r.nl), (r.w - r.wl, r.w1 - r.wl1, r.n - r.nl))
            first = top.split(r.node, r.feature, r.bin, r.gain * r.w, tuple(one / all_ for all_, one, _ in sides))
            for child, (all_, one, rows) in enumerate(sides, first):
                if depth + 1 < s.maxDepth and 0 < one < all_:
                    parts[r.tree][child] = depth + 1
                    if rows > s.node_rows:
                        further.append((r.tree, child))
        wanted = further
    return tops, parts


def _dealt(blocks: DataFrame, tops: list[Nodes], parts: dict[int, dict[int, int]], width: int, s: TaskForest) -> DataFrame:
    """What a task grows below each node that gets its rows (columns as ``_TREES``, with the node)."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, bins, y, w in _read(batches):
            for tree, nodes in parts.items():
                n = s.drawn(tree, block, len(y))
                some = (n > 0) & (w > 0)
                at = tops[tree].route(bins)
                for node in nodes:
                    here = np.flatnonzero(some & (at == node))
                    if len(here):
                        yield _record({
                            "tree": [tree], "node": [node], "block": [block], "bins": [bins[here].tobytes()], "y": [y[here].tobytes()],
                            "n": [n[here].astype(np.uint8).tobytes()], "w": [w[here].tobytes() if s.weightCol else b""],
                        }, _PARTS)

    shape = _TREES.replace("tree int", "tree int, node int")

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        tree, node = (int(k.as_py()) for k in key)
        table = table.sort_by("block")
        column = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        y, n = column("y", np.uint8).astype(float), column("n", np.uint8).astype(float)
        w = n * column("w", np.float64) if s.weightCol else n
        nodes = grown(column("bins", np.uint8).reshape(len(y), width), y, n, w, s, parts[tree][node], np.random.default_rng((s.seed, tree, node, 0)))
        return pa.Table.from_batches([_row(tree, nodes, shape, node=[node])])

    tasks = max(1, min(sum(map(len, parts.values())), 4 * _tasks(blocks)))
    return blocks.mapInArrow(deal, _PARTS).repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(grow, shape)


def _row(tree: int, nodes: Nodes, schema: str, **more: list) -> pa.RecordBatch:
    return _record({"tree": [tree], **{c: [a.astype(k).tobytes()] for (c, k), a in zip(_KINDS.items(), nodes.parts())}, **more}, schema)


def _nodes(batch: pa.RecordBatch | pa.Table, i: int) -> Nodes:
    return Nodes(*(np.frombuffer(batch[c][i].as_buffer(), k).copy() for c, k in _KINDS.items()))


def _whole(spark: SparkSession, below: DataFrame, tops: list[Nodes], parts: dict[int, dict[int, int]], width: int, s: TaskForest) -> DataFrame:
    """One row per tree that has seen rows; its last column has the gains by feature."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        tree, table = int(key[0].as_py()), table.sort_by("node")
        if 0 in parts[tree] and table.num_rows == 1:
            return _record({p.split()[0]: [] for p in _TREES.split(", ")}, _TREES).schema.empty_table()
        whole = Nodes(*(a.copy() for a in tops[tree].parts()))
        for i, node in enumerate(table["node"].to_pylist()):
            if node >= 0:
                whole.hang(node, _nodes(table, i))
        whole = whole.pruned()
        inner = whole.feature >= 0
        whole.gain = np.bincount(whole.feature[inner], whole.gain[inner], width)
        return pa.Table.from_batches([_row(tree, whole, _TREES)])

    blank = [F.lit(None).cast("binary").alias(c) for c in _KINDS]
    every = spark.range(s.numTrees).select(F.col("id").cast("int").alias("tree"), F.lit(-1).alias("node"), *blank)
    return below.unionByName(every).groupBy("tree").applyInArrow(join, _TREES)


@dataclass(frozen=True)
class TaskForestModel:
    """Adds probability and prediction to rows with a feature vector; ``attributions`` adds what each feature moved."""

    trees: DataFrame
    cuts: list[np.ndarray]
    featuresCol: str

    def facts(self) -> tuple[int, float, np.ndarray]:
        """(trees, mean value of the roots, importance of each feature)."""
        width = len(self.cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    nodes = _nodes(batch, i)
                    share = nodes.gain / nodes.gain.sum() if nodes.gain.any() else np.zeros(width)
                    yield _record({"tree": [batch["tree"][i].as_py()], "value": [float(nodes.value[0])], "share": [share.tobytes()]}, "tree int, value double, share binary")

        rows = self.trees.mapInArrow(run, "tree int, value double, share binary").orderBy("tree").collect()
        shares = sum(np.frombuffer(r.share, np.float64) for r in rows)
        return len(rows), sum(r.value for r in rows) / len(rows), shares / shares.sum() if shares.any() else shares

    @property
    def base(self) -> float:
        return self.facts()[1]

    @property
    def featureImportances(self) -> DenseVector:
        return DenseVector(self.facts()[2])

    def nodes(self) -> DataFrame:
        """(tree, node, left, right, feature, threshold, value, weight) of every node."""
        cuts, number = self.cuts, self.trees.count()
        shape = "tree int, node int, left int, right int, feature int, threshold double, value double, weight double"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    t = _nodes(batch, i)
                    m, inner = len(t.lft), t.feature >= 0
                    ends = [cuts[f][b] if f >= 0 else None for f, b in zip(t.feature.tolist(), t.bin.tolist())]
                    left, right = np.where(inner, t.lft, -1), np.where(inner, t.lft + 1, -1)
                    columns = [np.full(m, batch["tree"][i].as_py()), np.arange(m), left, right, t.feature]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(ends, pa.float64()), pa.array(t.value), pa.array(np.full(m, 1 / number))], names=[p.split()[0] for p in shape.split(", ")])

        return self.trees.mapInArrow(run, shape)

    def save(self, path: str) -> str:
        """Two tables: a row per tree, and a row of cuts per feature; ``load_forest`` reads them."""
        cuts = [(f, self.featuresCol, c.tolist()) for f, c in enumerate(self.cuts)]
        self.trees.write.mode("overwrite").parquet(f"{path}/trees")
        self.trees.sparkSession.createDataFrame(cuts, _CUTS).write.mode("overwrite").parquet(f"{path}/cuts")
        return path

    def transform(self, df: DataFrame) -> DataFrame:
        plain = [f.name for f in df.schema if isinstance(f.dataType, VectorUDT)]
        rows = df.withColumns({c: vector_to_array(c) for c in plain})
        p = F.col("_p")
        out = self._applied(rows, self.featuresCol, "_p", False).withColumns({c: array_to_vector(c) for c in plain})
        return out.withColumn("probability", array_to_vector(F.array(1 - p, p))).withColumn("prediction", (p > 0.5).cast("double")).drop("_p")

    def attributions(self, df: DataFrame, vec: str, out: str) -> DataFrame:
        """Adds an array as long as the row's; null where the vector or an entry is missing."""
        return self._applied(df, vec, out, True)

    def _applied(self, df: DataFrame, vec: str, out: str, explained: bool) -> DataFrame:
        """The rows with a tree's answers summed up, tree by tree, in blocks that hold still while the trees pass."""
        cuts, number = self.cuts, self.trees.count()
        width = len(cuts)

        def answers(pieces: list[pa.StructArray], trees: Iterator[Nodes]) -> Iterator[pa.RecordBatch]:
            whole, codes = [], []
            for piece in pieces:
                x = vector_matrix(piece.field(vec), width, finite=False)
                whole.append(~np.isnan(x).any(axis=1))
                codes.append(_codes(x, cuts))
            whole, codes = np.concatenate(whole), np.concatenate(codes)
            got = np.zeros(codes.shape if explained else len(codes))
            for t in trees:
                if explained:
                    flat = FlatTrees(np.zeros(1, np.int64), np.full(1, 1 / number), t.lft, t.lft + 1, t.feature, t.bin, t.value)
                    flat.attribute(codes, got)
                else:
                    got += t.value[t.route(codes)] / number
            at = 0
            for piece in pieces:
                here = slice(at, at := at + len(piece))
                if explained:
                    ends = pa.array(np.arange(len(piece) + 1, dtype=np.int32) * width)
                    answer = pa.ListArray.from_arrays(ends, pa.array(got[here].ravel()), mask=pa.array(~whole[here]))
                else:
                    answer = pa.array(got[here])
                yield pa.RecordBatch.from_arrays([*piece.flatten(), answer], names=[*(f.name for f in piece.type), out])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.StructArray] = []

            def passing(batch: pa.RecordBatch, first: int) -> Iterator[Nodes]:
                while batch is not None:
                    yield from (_nodes(batch, i) for i in range(first, batch.num_rows))
                    batch, first = next(batches, None), 0

            for batch in batches:  # the rows of a block come before the trees
                n = batch["tree"].null_count
                if n:
                    held.append(batch["row"].slice(0, n))
                if n < batch.num_rows:
                    if held:
                        yield from answers(held, passing(batch, n))
                    return

        row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()) if explained else T.DoubleType())])
        if df.isStreaming:  # no blocks there: the forest goes along with the tasks
            model = [Nodes(*(np.frombuffer(r[c], k) for c, k in _KINDS.items())) for r in self.trees.orderBy("tree").toLocalIterator()]
            return df.select(row.alias("row")).mapInArrow(lambda batches: (x for batch in batches for x in answers([batch["row"]], iter(model))), schema)
        staged = stage_table(df, "forest-rows")
        blocks = max(_tasks(df), math.ceil(staged.count() * width / HELD_ENTRIES))
        b = F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int")
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (p.split() for p in _TREES.split(", "))]
        rows = staged.select(b.alias("b"), row.alias("row"), *none)
        trees = self.trees.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "*")
        dealt = rows.unionByName(trees).repartitionById(blocks, "b").sortWithinPartitions(F.asc_nulls_first("tree")).drop("b")
        return dealt.mapInArrow(run, schema)


_CUTS = "idx int, features string, cuts array<double>"


def load_forest(spark: SparkSession, path: str) -> TaskForestModel:
    cuts = spark.read.schema(_CUTS).parquet(f"{path}/cuts").orderBy("idx").collect()
    return TaskForestModel(spark.read.schema(_TREES).parquet(f"{path}/trees"), [np.array(r.cuts, float) for r in cuts], cuts[0].features)
