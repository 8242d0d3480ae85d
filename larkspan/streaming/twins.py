"""Structured Streaming forms of the grouped operations: late rows are bounded by a watermark, so that state is too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(stream: DataFrame, ts: str, every: str, late: str, keys=(), slide: str | None = None, **exprs: Column) -> DataFrame:
    """Aggregates a key and time window; a window is final once the watermark has passed it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = F.window(ts, every, slide) if slide else F.window(ts, every)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(*[v.alias(k) for k, v in exprs.items()]).select(F.col("w.start").alias("start"), *keys, *exprs)


def dedup(stream: DataFrame, ts: str, late: str, keys) -> DataFrame:
    """The first row of each key among those the watermark still lets in."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([keys] if isinstance(keys, str) else list(keys))


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Everything that is there now, into a table in memory of the driver's catalogue (small results only)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def write(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
