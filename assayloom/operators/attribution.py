"""Attributions of tree ensembles per row, and explanations over several endpoint models.

Every node of a tree has the mean of its training rows. A row starts at the root's mean; each split on its way
moves the expected value, and the move is credited to the split's feature. Base plus attributions is the model's
score for the row: the positive probability of a forest, the mean of a regression forest, the margin of boosted
classification trees, the prediction of boosted regression trees.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import numpy as np
import pandas as pd
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayloom.operators.boosting import LeafwiseModel
from assayloom.operators.explain import common_features, linear_attribution, opposite_effects, top_of_array
from assayloom.operators.features import scale
from assayloom.operators.forest import TaskForestModel
from assayloom.operators.models import final_stage
from assayloom.operators.scoring import EndpointModel
from assayloom.operators.trees import FlatTrees
from assayloom.session import stage_path

NODES = "tree int, node int, left int, right int, feature int, threshold double, value double, weight double"
#: Nodes of one ensemble at most: 48 bytes each are sent to every executor, as the model itself is for scoring.
MOST_NODES = 16_000_000


def tree_nodes(model: Transformer) -> DataFrame:
    """Node table of a fitted forest or boosted model (columns as ``NODES``), read from its saved form.

    A forest's trees have equal weights that sum to 1, boosted trees their own. Splits on categories are an error.
    """
    from pyspark.sql import SparkSession

    spark, last = SparkSession.active(), final_stage(model)
    if isinstance(last, TaskForestModel):
        return last.nodes()
    if not hasattr(last, "treeWeights"):
        raise TypeError(f"{type(last).__name__} has no trees")
    path = stage_path(spark, "trees")
    last.write().overwrite().save(path)
    boosted = type(last).__name__.startswith("GBT")
    classes = hasattr(last, "numClasses") and not boosted
    stats = F.col("nodeData.impurityStats")
    value = stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x) if classes else F.col("nodeData.prediction")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "w")
    total = F.lit(1.0) if boosted else F.lit(float(len(last.treeWeights)))
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*", value.alias("value"))
    split = F.col("split.leftCategoriesOrThreshold")
    checked = F.when(F.col("split.numCategories") > 0, F.raise_error(F.lit("splits on categories are not supported")).cast("double")).otherwise(F.get(split, F.lit(0)))
    return nodes.join(weights, "tree").select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), checked.alias("threshold"), "value", (F.col("w") / total).alias("weight"),
    )


def flat_trees(nodes: DataFrame) -> FlatTrees:
    """The node table as arrays on the driver; its size is that of the model, and is checked."""
    if nodes.count() > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} nodes")
    t = nodes.toArrow()
    tree, node = (t[c].to_numpy().astype(np.int64) for c in ("tree", "node"))
    t = t.take(order := np.lexsort((node, tree)))
    mark = (tree[order] << 32) + node[order]
    feature = t["feature"].fill_null(-1).to_numpy().astype(np.int64)
    leaf = feature < 0

    def children(side: str) -> np.ndarray:
        wanted = np.where(leaf, mark, (tree[order] << 32) + t[side].fill_null(-1).to_numpy())
        at = np.searchsorted(mark, wanted)
        if len(at) and not np.array_equal(mark.take(at, mode="clip"), wanted):
            raise KeyError(f"{side}: a node is not there")
        return at

    roots = np.flatnonzero(np.diff(tree[order], prepend=-1))
    number = lambda c: t[c].cast("double").fill_null(float("nan")).to_numpy()
    return FlatTrees(roots, number("weight")[roots], children("left"), children("right"), np.where(leaf, -1, feature), number("threshold"), number("value"))


def tree_attribution(vec: Column, trees: FlatTrees) -> Column:
    """Attributions per row as an array as long as the row's; null where the vector or an entry is missing."""

    @F.pandas_udf("array<double>")
    def attribute(rows: pd.Series) -> pd.Series:
        whole = [i for i, v in enumerate(rows) if v is not None and not np.isnan(np.asarray(v, float)).any()]
        out: list[np.ndarray | None] = [None] * len(rows)
        if whole:
            for i, parts in zip(whole, trees.attribute(np.stack([np.asarray(rows.iloc[i], float) for i in whole]))):
                out[i] = parts
        return pd.Series(out, dtype=object)

    return attribute(vec)


def explain_trees(df: DataFrame, vec: str, trees: FlatTrees, out: str = "contributions") -> DataFrame:
    """Adds ``out``, base_value and score (base plus attributions) to every row."""
    rows = df.withColumn(out, tree_attribution(F.col(vec), trees)).withColumn("base_value", F.lit(trees.base))
    return rows.withColumn("score", F.col("base_value") + F.aggregate(out, F.lit(0.0), lambda a, x: a + x))


def _one(rows: DataFrame, vec: str, model) -> DataFrame:
    """(..., contributions, base_value) of a tree ensemble or of (coefficients, means, intercept)."""
    if isinstance(model, TaskForestModel):
        return model.attributions(rows, vec, "contributions").withColumn("base_value", F.lit(model.base))
    if isinstance(model, FlatTrees):
        return explain_trees(rows, vec, model).drop("score")
    coefficients, means, intercept = model
    base = float(intercept) + float(sum(c * m for c, m in zip(coefficients, means)))
    return linear_attribution(rows, vec, coefficients, means).withColumn("base_value", F.lit(base)).drop("attribution_sum")


def explain_endpoints(df: DataFrame, key: str, vec: str, models: Mapping[str, object], names: Sequence[str], k: int = 10) -> DataFrame:
    """Long table (key, endpoint, base_value, score, rank, idx, feature, value, ...) of the first ``k`` features.

    ``models`` has a FlatTrees, a TaskForestModel, or (coefficients, means, intercept), per endpoint. The table is read once: each
    model adds its answer to the row, and the row is unfolded at the end. Features that add nothing are not listed;
    rows without a usable vector have no features.
    """
    rows, added = df.select(key, vec), []
    for i, (endpoint, model) in enumerate(models.items()):
        rows = _one(rows, vec, model)
        whole = F.col("base_value") + F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x)
        answer = F.struct(F.lit(endpoint).alias("endpoint"), "base_value", whole.alias("score"), F.filter(top_of_array(F.col("contributions"), k, names), lambda e: e["value"] != 0).alias("top"))
        rows = rows.withColumn(f"_e{i}", answer).drop("contributions", "base_value")
        added.append(f"_e{i}")
    return rows.select(key, F.inline(F.array(*added))).select(key, "endpoint", "base_value", "score", F.inline("top"))


def explain_models(df: DataFrame, key: str, vec: str, models: Sequence[EndpointModel], names: Sequence[str], k: int = 10) -> DataFrame:
    """``explain_endpoints`` for fitted endpoint models, each on features scaled by its own state.

    Tree ensembles and linear models are explained; a model without either (a kernel machine) is an error.
    """
    parts = []
    for em in models:
        last = final_stage(em.model)
        if isinstance(last, LeafwiseModel):
            made = last.explained
        elif isinstance(last, TaskForestModel):
            made = last
        elif hasattr(last, "treeWeights"):
            made = flat_trees(tree_nodes(em.model))
        elif hasattr(last, "coefficients") and last is em.model:
            coefficients = last.coefficients.toArray().tolist()
            made = (coefficients, [0.0] * len(coefficients), float(last.intercept))
        else:
            raise TypeError(f"{em.endpoint}: {type(last).__name__} has no attributions")
        parts.append(explain_endpoints(scale(df.select(key, vec), vec, em.scaler), key, vec, {em.endpoint: made}, names, k))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def endpoint_insights(top: DataFrame, by: Sequence[str], k: int = 10) -> DataFrame:
    """(by..., kind, place, feature, detail): features that several endpoints share, and those they dispute."""
    shared = common_features(top, by, k=k).select(*by, F.lit("common").alias("kind"), "place", "feature", F.col("endpoints_affected").cast("string").alias("detail"))
    disputed = opposite_effects(top, by)
    return shared.unionByName(disputed.select(*by, F.lit("opposite").alias("kind"), "place", "feature", F.col("insight").alias("detail")))
