"""Where intermediate tables are written: the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: For a session on one machine that names no folder, such as a local test.
LOCAL_DIR = "/tmp/checkpoints/lodeworks"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; without it only a local session may go on, since executors share nothing else."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found or LOCAL_DIR


def cut_lineage(df: DataFrame, label: str = "rows") -> DataFrame:
    """The rows written in the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
