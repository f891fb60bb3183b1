"""Folders that the driver and all executors share, and tables written there to cut a long lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; below one of our own only where that is unset and all runs on one machine."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="ledgerspark-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


class Workspace:
    """Tables of one computation, in a folder of their own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.n = spark, shared_folder(spark, label), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written and read again: what follows no longer depends on how they were made."""
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")
