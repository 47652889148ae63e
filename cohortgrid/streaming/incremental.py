"""Incremental batches over files: what is done is skipped, what is new is processed once, and a log is appended to.

The windowed count over events is an addition of this library's own, not part of the operators it mirrors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def process_new(spark: SparkSession, folder: str, schema, out: str, checkpoint: str, transform=lambda df: df) -> None:
    """Each file of folder once, however often it is called."""
    stream = spark.readStream.schema(schema).parquet(folder)
    transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def work_list(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done.select(*keys).distinct(), keys, "left_anti")


def windowed_counts(events: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
