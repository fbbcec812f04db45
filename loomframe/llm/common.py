"""Tables of a data folder, and what the library has for shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomframe.storage import Scratch, new_path, remove, written

__all__ = ["Scratch", "new_path", "remove", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
