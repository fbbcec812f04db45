"""The shared folder and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a temporary one where a local session (a test) names none."""
    base = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{SHARED} is not set: it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomframe-")
        spark.conf.set(SHARED, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """`df` written to the shared folder and read back: lineage ends in replicated files."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written under one folder of the shared directory, which goes when what is made from them is written."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.folder, self.n = spark, new_path(spark, what), 0

    def written(self, df: DataFrame, what: str) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}-{what}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.folder)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


