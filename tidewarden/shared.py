"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; only a local session may name none. A local session removes it
    when its Python process ends."""
    named, local = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master.startswith("local[")
    if not named and not local:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = f"{(named or '/tmp/tidewarden').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if local:
        atexit.register(shutil.rmtree, path.removeprefix("file:"), ignore_errors=True)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and losing an executor loses nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
