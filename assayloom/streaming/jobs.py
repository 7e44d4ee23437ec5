"""Stream jobs: score arriving rows, drop repeated requests, keep daily risk counts.

Each job takes a streaming DataFrame and returns a started query with ``availableNow``; the caller waits.
Checkpoints live under the shared work folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from assayloom.functions.scores import risk_level
from assayloom.session import stage_path


def read_stream(spark: SparkSession, folder: str, schema: T.StructType | str, glob: str, timestamp: str | None = None) -> DataFrame:
    """File-source stream; a zone-less timestamp column is cast so that it can carry a watermark."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return stream if timestamp is None else stream.withColumn(timestamp, F.col(timestamp).cast("timestamp"))


def _start(df: DataFrame, path: str, checkpoint: str | None) -> StreamingQuery:
    return (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or stage_path(df.sparkSession, "stream-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stream_score(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame] | Column, path: str, checkpoint: str | None = None
) -> StreamingQuery:
    """Stateless scoring into parquet: ``score`` is a transform (such as a fitted model's) or a column."""
    if isinstance(score, Column):
        scored = stream.withColumn("score", score)
    else:
        scored = score(stream)
    return _start(scored.withColumn("level", risk_level(F.col("score"))), path, checkpoint)


def stream_dedup_score(
    stream: DataFrame, keys: Sequence[str], timestamp: str, delay: str,
    score: Callable[[DataFrame], DataFrame] | Column, path: str, checkpoint: str | None = None,
) -> StreamingQuery:
    """Score only the first request of a key within the watermark delay; later repeats past it score again."""
    fresh = stream.withWatermark(timestamp, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream_score(fresh, score, path, checkpoint)


def stream_risk_counts(
    stream: DataFrame, timestamp: str, level: str, path: str, window: str = "1 day", delay: str = "1 hour",
    checkpoint: str | None = None,
) -> StreamingQuery:
    """Counts per window and level. Each batch appends the windows it changed with its batch number;
    :func:`latest_counts` keeps the last value per window. A batch that is run again writes the same folder.
    """
    counts = (
        stream.withWatermark(timestamp, delay)
        .groupBy(F.window(timestamp, window).alias("w"), F.col(level).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), "level", "n")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    return (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint or stage_path(stream.sparkSession, "stream-state"))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("window_start timestamp, level string, n long, batch long").parquet(f"{path}/batch_no=*")
    return rows.groupBy("window_start", "level").agg(F.max_by("n", "batch").alias("n"))
