"""Report on feature representations: cross-validation on training rows, a holdout, and paired tests."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from assayloom.operators import models as M
from assayloom.operators.splits import repeated_kfold, repeated_stratified_kfold, split, stratified_split
from assayloom.operators.validation import compare_folds, cv_summary, unpivot_metrics

# Metrics of the report, share of the holdout, folds and repeats.
REPORTED = {
    "classification": ("auc", "mcc", "balanced_accuracy", "average_precision"),
    "regression": ("r2", "rmse", "mae", "ccc"),
}
HOLDOUT, FOLDS, REPEATS = 0.2, 5, 3


@dataclass(frozen=True)
class Comparison:
    """``folds``: summary by representation, model and metric; ``holdout``: one row of metrics per representation and
    model; ``tests``: paired tests of fold AUC or r2 against the first representation."""

    folds: DataFrame
    holdout: DataFrame
    tests: DataFrame


def compare(
    aligned: DataFrame, task: str, k: int = FOLDS, repeats: int = REPEATS, holdout: float = HOLDOUT,
    settings: dict[str, dict] = M.COMPARISON, models: Iterable[str] | None = None, components: int = 256, seed: int = 42,
) -> Comparison:
    """Compare ``x2d``, ``x3d`` and both of (key, x2d, x3d, y): the same holdout and folds for every model and representation.

    The holdout is cut first, inside classes for classification, and no fold sees it. Classes have balanced weights in
    forest and kernel machine.
    """
    if task == "classification":
        parts = stratified_split(aligned, "key", "y", holdout, 0.0, seed)
    else:
        parts = split(aligned, "key", holdout, 0.0, seed)
    train = parts.where("split = 'train'")
    if task == "classification":
        folds = repeated_stratified_kfold(train.select("key", "y"), "key", "y", k, repeats, seed)
    else:
        folds = repeated_kfold(train.select("key"), "key", k, repeats, seed)
    preds = M.compare_representations(train, folds, task, k, repeats, settings, models, components)
    per_fold = M.all_metrics(preds, task, ["representation", "model", "repeat", "fold"])
    ids, names = ["representation", "model"], list(REPORTED[task])
    long = unpivot_metrics(per_fold.select(*ids, *names), ids, names)
    held = M.holdout_representations(parts, task, settings, models, components)
    return Comparison(
        cv_summary(long, [*ids, "metric"], ddof=1),
        M.all_metrics(held, task, ids).select(*ids, *names, "n"),
        compare_folds(M.fold_scores(preds, task)),
    )
