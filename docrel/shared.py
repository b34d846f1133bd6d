"""Tables written between steps, in a folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a temporary folder where that is unset, as in local tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="docrel-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/docrel-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
