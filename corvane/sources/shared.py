"""The folder that the driver and all executors share."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder's name in spark.checkpoint.dir; where that is unset, a local session gets a temporary one.

    A cluster without the setting is an error: executors would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder or tempfile.mkdtemp(prefix='corvane-')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder once and read back, for a frame that a plan reads more than once."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
