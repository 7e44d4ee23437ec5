"""Training, tuning and cross-validation with Spark ML.

Tables are (key, features ARRAY<DOUBLE>, y DOUBLE) plus a split or fold column. Each fitted table is
written once to the shared work folder and read by every model, which also cuts lineage. Predictions are
one long table and all metrics are one grouped aggregation over it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.base import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayloom.operators.boosting import LeafwiseBooster, booster
from assayloom.operators.features import fit_standard, scale
from assayloom.operators.folds import fold_classes, fold_moments, train_moments, train_weight
from assayloom.operators.forest import TaskForest
from assayloom.operators.kernel import TUBE, LandmarkKernel, MarginMachine
from assayloom.operators.metrics import classification_metrics, cv_q2, ranking_metrics, regression_metrics, roc_auc
from assayloom.operators.resample import smote
from assayloom.operators.search import Trial, best, draw, search
from assayloom.operators.splits import balanced_weights
from assayloom.session import stage_table

# Settings of the baseline and comparison models, tuning ranges and budget.
BASELINE = {
    "forest": {"numTrees": 300, "maxDepth": 20},
    "boosted": {"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8},
    "kernel": {"C": 10.0},
}
COMPARISON = {
    "forest": {"numTrees": 500, "maxDepth": 30},
    "boosted": {"maxIter": 400, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.9},
    "kernel": {"C": 1.0},
}
TUNING = {
    "forest": {
        "numTrees": ("step", 100, 500, 50), "maxDepth": ("int", 5, 30), "minInstancesPerNode": ("int", 1, 10),
        "featureSubsetStrategy": ("choice", "sqrt", "log2", "all"),
    },
    "boosted": {
        "maxIter": ("step", 100, 500, 50), "maxDepth": ("int", 3, 10), "stepSize": ("log", 0.01, 0.3),
        "subsamplingRate": ("float", 0.6, 1.0),
    },
    "leafwise": {
        "rounds": ("step", 100, 500, 50), "depth": ("int", 3, 12), "rate": ("log", 0.01, 0.3), "rows": ("float", 0.6, 1.0),
        "columns": ("float", 0.6, 1.0), "l1": ("log", 1e-8, 10.0), "l2": ("log", 1e-8, 10.0), "leaves": ("int", 20, 150),
    },
}
TRIALS, TUNING_FOLDS = 30, 3
#: Nodes that the settings of Spark's own forest may allow: its driver holds them all.
DRIVER_NODES = 500_000


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel (Rahimi and Recht 2007): sqrt(2/D) cos(Wx + b).

    W and b follow from the seed, the width and gamma, so nothing is stored or collected.
    """

    components = Param(Params._dummy(), "components", "number of features D", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, seed=42, components=256, gamma=1.0):
        super().__init__()
        self._setDefault(components=256, gamma=1.0)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, gamma, seed = self.getOrDefault(self.components), self.getOrDefault(self.gamma), self.getSeed()

        @F.pandas_udf("array<double>")
        def expand(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            x = np.stack(v.to_numpy()).astype(float)
            draw = np.random.default_rng(seed)
            w = draw.standard_normal((x.shape[1], size)) * math.sqrt(2 * gamma)
            b = draw.uniform(0, 2 * math.pi, size)
            return pd.Series(list(math.sqrt(2.0 / size) * np.cos(x @ w + b)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(expand(vector_to_array(F.col(self.getInputCol())))))


def scale_gamma(train: DataFrame, vec: str = "features") -> float:
    """1 / (features x variance over all entries)."""
    stats = train.select(F.size(vec).alias("p"), F.explode(vec).alias("x")).agg(F.max("p").alias("p"), F.var_pop("x").alias("v")).first()
    return 1.0 / (stats.p * stats.v) if stats.p and stats.v else 1.0


def forest(task: str, settings: dict, weight: str | None = None, seed: int = 42) -> Estimator | TaskForest:
    """Spark's forest, or one that stays in tasks where the settings allow a larger one of classes."""
    options = {"featuresCol": "x", "labelCol": "y", "seed": seed, **({"weightCol": weight} if weight else {}), **settings}
    if task == "regression":
        return RandomForestRegressor(**options)
    large = settings.get("numTrees", 20) * 2 ** (settings.get("maxDepth", 5) + 1) > DRIVER_NODES
    return (TaskForest if large else RandomForestClassifier)(**options)


def model_set(
    task: str, settings: dict[str, dict] = BASELINE, gamma: float = 1.0, weight: str | None = None,
    components: int = 256, seed: int = 42,
) -> dict[str, Estimator | LeafwiseBooster]:
    """Forest, boosted trees grown level by level, boosted trees grown leaf by leaf, and a kernel machine on landmarks."""
    common = {"featuresCol": "x", "labelCol": "y", "seed": seed}
    w = {"weightCol": weight} if weight else {}
    kernel = LandmarkKernel(inputCol="x", outputCol="z", seed=seed, components=components, gamma=gamma)
    margin = {"featuresCol": "z", "labelCol": "y", "cost": settings["kernel"]["C"], **w}
    if task == "regression":
        return {
            "RandomForest": forest(task, settings["forest"], weight, seed),
            "BoostedTrees": GBTRegressor(**common, **settings["boosted"], **w),
            "LeafwiseTrees": booster(task, settings["boosted"], weight, seed),
            "KernelSVR": Pipeline(stages=[kernel, MarginMachine(outputCol="prediction", tube=settings["kernel"].get("tube", TUBE), **margin)]),
        }
    return {
        "RandomForest": forest(task, settings["forest"], weight, seed),
        "BoostedTrees": GBTClassifier(**common, **settings["boosted"], **w),
        "LeafwiseTrees": booster(task, settings["boosted"], weight, seed),
        "KernelSVC": Pipeline(stages=[
            kernel,
            MarginMachine(outputCol="margin", **margin),
            LogisticRegression(featuresCol="margin", labelCol="y", **w),
        ]),
    }


def comparison_set(
    task: str, settings: dict[str, dict], gamma: float, components: int, balanced: bool, seed: int = 42
) -> dict[str, Estimator | LeafwiseBooster]:
    """The model set with balanced class weights (column ``weight``) in forest and kernel machine, none in the boosted families."""
    plain = model_set(task, settings, gamma, None, components, seed)
    if not balanced:
        return plain
    weighed = model_set(task, settings, gamma, "weight", components, seed)
    return {name: plain[name] if name in ("BoostedTrees", "LeafwiseTrees") else weighed[name] for name in plain}


def with_vector(df: DataFrame, vec: str = "features") -> DataFrame:
    return df.withColumn("x", array_to_vector(F.col(vec)))


def predictions(fitted: Transformer, rows: DataFrame, task: str, keep: Sequence[str]) -> DataFrame:
    """(keep..., y, prediction, score); the score is the positive probability, or the prediction itself."""
    out = fitted.transform(with_vector(rows))
    score = F.col("prediction") if task == "regression" else vector_to_array("probability")[1]
    return out.select(*keep, F.col("y").cast("double").alias("y"), F.col("prediction").cast("double").alias("prediction"), score.alias("score"))


def prepared(
    train: DataFrame, others: DataFrame, task: str, oversample: bool = True, weighted: bool = False,
    keep: Sequence[str] = ("key", "y"), name: str = "fit", seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Scaled training table (over-sampled when asked) and the other rows scaled by the same state."""
    state = fit_standard(train, "features")
    fit = scale(train, "features", state).select("key", "features", "y")
    if task == "classification" and oversample:
        fit = smote(fit, "key", "features", "y", seed)
    if weighted:
        fit = balanced_weights(fit, "y")
    rest = scale(others, "features", state).select(*keep, "features")
    return with_vector(stage_table(fit, f"{name}-train")), stage_table(rest, f"{name}-rest")


def all_metrics(preds: DataFrame, task: str, by: Sequence[str]) -> DataFrame:
    """Metrics per group from a prediction table."""
    by = list(by)
    if task == "regression":
        return regression_metrics(preds, "y", "prediction", by)
    return classification_metrics(preds, "y", "prediction", by).join(ranking_metrics(preds, "score", "y", by), by)


def train_all(
    table: DataFrame, task: str, settings: dict[str, dict] = BASELINE, models: Iterable[str] | None = None,
    oversample: bool = True, components: int = 256,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit the model set on split='train', predict split='test': (fitted models, prediction table).

    The predictions are written once, so every metric reads them and no model answers twice.
    """
    train, test = table.where(F.col("split") == "train"), table.where(F.col("split") == "test")
    fit, rest = prepared(train, test, task, oversample)
    chosen = model_set(task, settings, scale_gamma(fit), components=components)
    fitted, parts = {}, []
    for name, estimator in chosen.items():
        if models is None or name in models:
            fitted[name] = estimator.fit(fit)
            parts.append(predictions(fitted[name], rest, task, ["key"]).withColumn("model", F.lit(name)))
    return fitted, stage_table(_union(parts), "predictions")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_validate(
    table: DataFrame, folds: DataFrame, task: str, k: int, repeats: int, settings: dict[str, dict] = BASELINE,
    models: Iterable[str] | None = None, oversample: bool = True, components: int = 256, balanced: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Repeated k-fold: (predictions by model, repeat and fold; training means by repeat and fold).

    ``folds`` has (key, repeat, fold); the feature table is written once, with one fold column per repeat, and one
    aggregation over it gives the scaling state and mean of every fold's training rows. Training rows are read from
    that table and scaled on the way; only over-sampled ones are written per fold. ``balanced`` weighs the classes.
    """
    spark = table.sparkSession
    places = [f"fold_{r}" for r in range(repeats)]
    by_repeat = folds.groupBy("key").agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(p) for r, p in enumerate(places)])
    joined = stage_table(table.select("key", "features", "y").join(by_repeat, "key"), "folds")
    moments = fold_moments(joined, places)
    made = task == "classification" and oversample
    classes = fold_classes(joined, places) if balanced and not made else {}
    parts, means = [], []
    for r, place in enumerate(places):
        for i in range(k):
            state = train_moments(moments, r, i)
            scaled = scale(joined, "features", state.state(spark))
            fit, rest = scaled.where(F.col(place) != i).select("key", "features", "y"), scaled.where(F.col(place) == i)
            if made:
                fit = stage_table(smote(fit, "key", "features", "y"), f"cv-{r}-{i}")
            if balanced:
                fit = balanced_weights(fit, "y") if made else fit.withColumn("weight", train_weight(classes, r, i))
            fit = with_vector(fit)
            gamma = scale_gamma(fit) if made else state.scaled_gamma
            for name, estimator in comparison_set(task, settings, gamma, components, balanced).items():
                if models is None or name in models:
                    got = predictions(estimator.fit(fit), rest, task, ["key"])
                    parts.append(got.withColumns({"model": F.lit(name), "repeat": F.lit(r), "fold": F.lit(i)}))
            means.append((state.y_mean, r, i))
    return stage_table(_union(parts), "cv-predictions"), spark.createDataFrame(means, "train_mean double, repeat int, fold int")


def cv_metrics(preds: DataFrame, means: DataFrame, task: str) -> DataFrame:
    """Fold metrics by (model, repeat, fold); regression adds q2 against the training mean."""
    by = ["model", "repeat", "fold"]
    out = all_metrics(preds, task, by)
    if task == "regression":
        out = out.drop("q2").join(cv_q2(preds, means, "y", "prediction", by, ["repeat", "fold"]), by)
    return out


def draw_settings(family: str, trials: int, seed: int = 42) -> list[dict]:
    """Seeded random draws from the tuning ranges of a family."""
    return [draw(TUNING[family], np.random.default_rng((seed, n))) for n in range(trials)]


def tuned_estimator(task: str, family: str, params: dict, weight: str | None = None, seed: int = 42) -> Estimator | LeafwiseBooster:
    if family == "leafwise":
        return booster(task, params, weight, seed)
    if family == "forest":
        return forest(task, params, weight, seed)
    maker: Callable = GBTRegressor if task == "regression" else GBTClassifier
    extra = {"weightCol": weight} if weight else {}
    return maker(featuresCol="x", labelCol="y", seed=seed, **params, **extra)


def weight_space(task: str, family: str, positives: int, negatives: int) -> dict[str, tuple]:
    """Tuning range of the class weights: balanced or none, or a weight of the positive class around their ratio."""
    if task != "classification":
        return {}
    if family != "boosted":
        return {"class_weight": ("choice", "balanced", "none")}
    ratio = negatives / max(1, positives)
    low, high = (1.0, max(2.0, 2 * ratio)) if negatives > positives else (max(0.1, ratio / 2), 1.0)
    return {"positive_weight": ("float", low, high)}


def with_class_weight(df: DataFrame, params: dict, label: str = "y") -> tuple[DataFrame, dict, str | None]:
    """(rows with their weight, settings without the weights, weight column) of a trial."""
    rest = {k: v for k, v in params.items() if k not in ("class_weight", "positive_weight")}
    if params.get("class_weight") == "balanced":
        return balanced_weights(df, label), rest, "weight"
    if "positive_weight" in params:
        return df.withColumn("weight", F.when(F.col(label) == 1, params["positive_weight"]).otherwise(1.0)), rest, "weight"
    return df, rest, None


def tune(
    table: DataFrame, folds: DataFrame, task: str, trials: int = TRIALS, k: int = TUNING_FOLDS,
    families: Sequence[str] = tuple(TUNING), override: dict | None = None, parallelism: int = 4, seed: int = 42,
    guided: bool = True, stop: bool = True, weights: bool = True, oversample: bool = False,
) -> tuple[DataFrame, dict]:
    """Guided search: (trial table, best trial). Score is mean r2, or mean f1 of the positive class.

    Folds are rungs: poor trials stop after the first of them. Class weights are settings like the others (unless
    ``weights`` is off). Scaling, and over-sampling when asked, happen inside each fold and are shared by all its
    trials; the trials of a batch are submitted side by side.
    """
    joined = stage_table(table.join(folds.where(F.col("repeat") == 0).select("key", "fold"), "key"), "tune")
    parts = [prepared(joined.where(F.col("fold") != i), joined.where(F.col("fold") == i), task, oversample, name=f"tune-{i}") for i in range(k)]
    classes = {r.y: r["count"] for r in joined.groupBy("y").count().collect()} if task == "classification" else {}
    metric, measure = ("r2", regression_metrics) if task == "regression" else ("f1", classification_metrics)
    rows, winners = [], []
    for family in families:
        fixed = (override or {}).get(family, {})

        def evaluate(now: list[Trial], rung: int, family: str = family, fixed: dict = fixed) -> list[float]:
            fit, rest = parts[rung]

            def run(trial: Trial) -> DataFrame:
                weighed, params, weight = with_class_weight(fit, {**trial.params, **fixed})
                model = tuned_estimator(task, family, params, weight, seed).fit(weighed)
                return predictions(model, rest, task, ["key"]).withColumn("trial", F.lit(trial.number))

            with ThreadPool(parallelism) as pool:
                preds = pool.map(run, now)
            got = {r.trial: r[metric] for r in measure(_union(preds), "y", "prediction", ["trial"]).select("trial", metric).collect()}
            return [got[t.number] for t in now]

        space = {**TUNING[family], **(weight_space(task, family, classes.get(1.0, 0), classes.get(0.0, 0)) if weights else {})}
        found = search(space, evaluate, trials, k, parallelism, seed, guided, stop)
        rows += [(family, t.number, t.value, len(t.scores), str(sorted({**t.params, **fixed}.items()))) for t in found]
        top = best(found)
        winners.append({"family": family, "trial": top.number, "params": {**top.params, **fixed}, "score": top.value})
    spark = table.sparkSession
    return spark.createDataFrame(rows, "family string, trial int, score double, folds int, params string"), max(winners, key=lambda w: w["score"])


def refit_best(table: DataFrame, task: str, best: dict, seed: int = 42) -> tuple[Transformer, DataFrame]:
    """The best trial fitted on the original training rows, with its test predictions."""
    train, test = table.where(F.col("split") == "train"), table.where(F.col("split") == "test")
    fit, rest = prepared(train, test, task, oversample=False, name="refit")
    weighed, params, weight = with_class_weight(fit, best["params"])
    model = tuned_estimator(task, best["family"], params, weight, seed).fit(weighed)
    return model, predictions(model, rest, task, ["key"]).withColumn("model", F.lit(f"{best['family']}_optimized"))


REPRESENTATIONS = ("2D", "3D", "Hybrid")


def represented(aligned: DataFrame, rep: str, keep: Sequence[str] = ()) -> DataFrame:
    """(key, features, y, keep...) of a representation: the first features, the second ones, or both side by side."""
    features = {"2D": F.col("x2d"), "3D": F.col("x3d"), "Hybrid": F.concat("x2d", "x3d")}[rep]
    return aligned.select("key", features.alias("features"), "y", *keep)


def compare_representations(
    aligned: DataFrame, folds: DataFrame, task: str, k: int, repeats: int, settings: dict[str, dict] = COMPARISON,
    models: Iterable[str] | None = None, components: int = 256, balanced: bool = True,
) -> DataFrame:
    """Fold predictions of 2D, 3D and stacked features on the same folds: (representation, model, repeat, fold, key, y, ...).

    Classes have balanced weights unless ``balanced`` is off.
    """
    parts = []
    for rep in REPRESENTATIONS:
        got, _ = cross_validate(
            represented(aligned, rep), folds, task, k, repeats, settings, models, oversample=False, components=components,
            balanced=balanced and task == "classification",
        )
        parts.append(got.withColumn("representation", F.lit(rep)))
    return _union(parts)


def holdout_representations(
    aligned: DataFrame, task: str, settings: dict[str, dict] = COMPARISON, models: Iterable[str] | None = None,
    components: int = 256, balanced: bool = True,
) -> DataFrame:
    """Predictions of rows with split='test' by models fitted on split='train': (representation, model, key, y, ...)."""
    parts, weigh = [], balanced and task == "classification"
    for rep in REPRESENTATIONS:
        rows = represented(aligned, rep, ["split"])
        train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
        fit, rest = prepared(train, test, task, oversample=False, weighted=weigh, name="holdout")
        for name, estimator in comparison_set(task, settings, scale_gamma(fit), components, weigh).items():
            if models is None or name in models:
                got = predictions(estimator.fit(fit), rest, task, ["key"])
                parts.append(got.withColumns({"model": F.lit(name), "representation": F.lit(rep)}))
    return stage_table(_union(parts), "holdout-predictions")


def fold_scores(preds: DataFrame, task: str) -> DataFrame:
    """(representation, model, fold, value): fold AUC, or fold r2, with repeats numbered through."""
    by = ["representation", "model", "repeat", "fold"]
    scores = (
        regression_metrics(preds, "y", "prediction", by).withColumnRenamed("r2", "value")
        if task == "regression"
        else roc_auc(preds, "score", "y", by).withColumnRenamed("auc", "value")
    )
    return scores.select("representation", "model", F.struct("repeat", "fold").alias("fold"), "value")


def final_stage(model) -> Transformer:
    return model.stages[-1] if isinstance(model, PipelineModel) else model


def importance_topk(spark, model, names: Sequence[str], k: int = 20) -> DataFrame:
    """Features by model-level importance (absolute coefficient for linear models); empty for others."""
    last = final_stage(model)
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray().tolist()
    elif hasattr(last, "coefficients"):
        values = [abs(c) for c in last.coefficients.toArray().tolist()]
    else:
        values = []
    rows = [(n, float(v)) for n, v in zip(names, values)] if len(values) == len(names) else []
    table = spark.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), "feature").limit(k)
