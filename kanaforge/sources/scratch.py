"""Intermediate tables in the folder that the driver and all executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    return tempfile.mkdtemp(prefix="kanaforge-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine's only where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or _own()


def written(df: DataFrame) -> DataFrame:
    """df as a table that is read again; it stays until the folder's owner clears it."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
