"""Saved state of fitted operators: small parquet tables and Spark ML writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from assayloom.operators.boosting import LeafwiseModel, load_leafwise
from assayloom.operators.forest import TaskForestModel, load_forest


def save_state(state: DataFrame, path: str) -> str:
    """Persist a fitted state table (selected columns, scaler parameters, domain, cut points)."""
    state.write.mode("overwrite").parquet(path)
    return path


def load_state(spark: SparkSession, path: str) -> DataFrame:
    """Reload a state table; a missing one is an error that names the path."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        raise FileNotFoundError(f"no saved state at {path}; fit the step first") from missing


def save_model(model: PipelineModel | LeafwiseModel | TaskForestModel, path: str) -> str:
    if isinstance(model, LeafwiseModel | TaskForestModel):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel | LeafwiseModel | TaskForestModel:
    """A saved model of any kind; a missing one is an error that names the path."""
    for load in (load_leafwise, load_forest):
        try:
            return load(SparkSession.active(), path)
        except AnalysisException:
            pass  # no such trees there
    try:
        return PipelineModel.load(path)
    except Exception as missing:
        raise FileNotFoundError(f"no saved model at {path}; train it first") from missing
