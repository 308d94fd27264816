"""Session settings the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Recording the Python call site of every column operation triples the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str = "promptloom", **settings: str) -> SparkSession:
    """A session with the engine's settings; the cluster's own master and sizes are kept."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, default: str | None = None) -> str:
    """The shared folder the cluster names for written state; ``default`` where none is named.

    Without either this fails: state in a machine-local folder would be lost with its executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or default
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str, default: str | None = None) -> str:
    """Path of a not yet existing folder under the shared folder."""
    return f"{shared_folder(spark, default)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, default: str | None = None) -> DataFrame:
    """Write a result that several queries read to the shared folder, and read it back."""
    path = new_folder(df.sparkSession, name, default)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
