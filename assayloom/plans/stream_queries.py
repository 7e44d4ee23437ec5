"""Stream jobs over the events table, read back as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayloom.functions.scores import risk_level
from assayloom.plans.catalogue import register
from assayloom.session import stage_path
from assayloom.streaming import jobs

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, d):
    return jobs.read_stream(spark, d, EVENTS, "events.parquet", "ts")


def _score():
    return F.least(F.col("value") / 200, F.lit(1.0))


@register("stream_score", """
    SELECT event_id, least(value / 200, 1) AS score, CASE WHEN value / 200 < 0.3 THEN 'low' WHEN value / 200 < 0.7 THEN 'moderate' ELSE 'high' END AS level FROM events""")
def stream_score(spark, d):
    path = stage_path(spark, "scored")
    jobs.stream_score(event_stream(spark, d), _score(), path).awaitTermination()
    return spark.read.schema("event_id long, score double, level string").parquet(path)


@register("stream_dedup", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY user_id, event_type")
def stream_dedup(spark, d):
    """Requests keyed by user and type, which repeat; the delay spans the table, so one of each is scored."""
    path = stage_path(spark, "dedup")
    jobs.stream_dedup_score(event_stream(spark, d), ["user_id", "event_type"], "ts", "3650 days", _score(), path).awaitTermination()
    rows = spark.read.schema("user_id long, event_type string").parquet(path)
    return rows.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@register("stream_risk_counts", """
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CASE WHEN value / 200 < 0.3 THEN 'low' WHEN value / 200 < 0.7 THEN 'moderate' ELSE 'high' END AS level, count(*) AS n FROM events GROUP BY ALL""")
def stream_risk_counts(spark, d):
    path = stage_path(spark, "counts")
    stream = event_stream(spark, d).withColumn("level", risk_level(_score()))
    jobs.stream_risk_counts(stream, "ts", "level", path).awaitTermination()
    return jobs.latest_counts(spark, path).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "level", "n")
