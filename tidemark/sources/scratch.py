"""A fresh folder for intermediate tables, below the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A session without the setting gets a folder of its own where driver and executors are one machine.

    On a cluster it is an error: executors would write to their own disks and the read back would miss rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"{name}-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in a scratch folder, for what several steps of a plan read: computed once."""
    folder = f"{scratch_dir(df.sparkSession, name)}/{name}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
