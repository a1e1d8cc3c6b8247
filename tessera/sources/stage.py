"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only on one machine may that be unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` and read it back: costly columns are computed once for all that use them. The table stays."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staging:
    """A call's tables in the shared folder, deleted when the call ends or fails; what the call returns must not read them."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, shared_folder(spark, what), 0

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before(self, table: DataFrame) -> None:
        """Delete the tables written before ``table``, which must be the last one."""
        for k in range(1, self.n):
            delete(self.spark, f"{self.root}/{k}")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
