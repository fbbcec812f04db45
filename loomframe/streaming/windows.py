"""Windows over event streams: the same functions take a streaming or a batch DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def lazy_map(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()])


def lazy_filter(df: DataFrame, p: Column) -> DataFrame:
    return df.filter(p)


def late_until(df: DataFrame, time: str, delay: str) -> DataFrame:
    return df.withWatermark(time, delay) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None, delay: str = "0 seconds", **aggregates: Column) -> DataFrame:
    """Aggregates of each window and key, with window_start and window_end; sliding where `slide` is given."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    got = late_until(df, time, delay).groupBy(window.alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], delay: str = "0 seconds", **aggregates: Column) -> DataFrame:
    got = late_until(df, time, delay).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return got.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, to parquet, and no more."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
