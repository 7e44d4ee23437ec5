"""Session helpers: a local builder for tests and the shared work folder used on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_WORK: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("assayloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stage tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and the
    master is local (tests, a laptop) is a local folder made, once per application, and registered as the
    checkpoint folder; on a cluster it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_WORK:
        _LOCAL_WORK[app] = tempfile.mkdtemp(prefix="assayloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL_WORK[app])
    return _LOCAL_WORK[app]


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the work folder for a stage table or a stream checkpoint."""
    return f"{work_root(spark)}/stages/{name}-{uuid.uuid4().hex}"


def stage_table(df, name: str):
    """Write ``df`` to the work folder and read it back: a lineage cut that survives lost executors."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
