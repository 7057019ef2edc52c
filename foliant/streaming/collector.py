"""Benchmark results as they arrive: a file stream with late and repeated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ROW = "lat_id LONG, strategy STRING, latency_ms DOUBLE, error STRING, run_at TIMESTAMP, loaded_at TIMESTAMP"


def result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of the JSON files that come into a folder."""
    return spark.readStream.schema(ROW).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def once_each(rows: DataFrame, late: str = "10 days") -> DataFrame:
    """Each lat_id once; a repeat that comes within the watermark's delay is dropped, and the state of older ones is let go."""
    return rows.withWatermark("run_at", late).dropDuplicatesWithinWatermark(["lat_id"])


def daily_latency(rows: DataFrame) -> DataFrame:
    """Count, errors and mean latency by strategy and day; a day is final when the watermark has passed it."""
    valid = F.col("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (F.col("latency_ms") >= 0)
    return rows.groupBy(F.window("run_at", "1 day"), "strategy").agg(F.count("*").alias("rows"), F.count("error").alias("errors"), F.sum(F.when(valid, F.col("latency_ms"))).alias("total_ms"), F.count_if(valid).alias("measured"))


def collect(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop; the next call goes on from the checkpoint."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
