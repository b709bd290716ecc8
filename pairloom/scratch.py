"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own_folder() -> str:
    """One temporary folder for a local driver's whole life; the session's settings stay as they are."""
    return "file://" + tempfile.mkdtemp(prefix="pairloom-")


class Scratch:
    """Tables written under the folder that driver and executors share.

    A written table cuts lineage, survives lost executors and is read back with its
    real size known to the optimizer. The folder is ``spark.checkpoint.dir``; only a
    local session without that setting gets a temporary folder of its own.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = _own_folder()
        self.root = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a reader of the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)
