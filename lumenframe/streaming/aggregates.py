"""Keyed reductions over streams. Builders are order-independent, so their batch and stream results agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.builders import REDUCE


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def keyed(stream: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str]]) -> DataFrame:
    return stream.groupBy(*keys).agg(*[REDUCE[op](c).alias(n) for n, (op, c) in aggs.items()])


def windowed(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], aggs: dict[str, tuple[str, str]], slide: str | None = None) -> DataFrame:
    """Reductions by event-time window; rows later than the watermark are left out and their state is dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(*[REDUCE[op](c).alias(n) for n, (op, c) in aggs.items()])
    return out.select(F.col("w.start").alias("window_start"), *keys, *aggs)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run all available input into an in-memory table and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
