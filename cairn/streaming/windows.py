"""Event-time windows over files that arrive, as a stream with late-data bounds."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.shared import shared_folder


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by type and tumbling window, for a stream or a table; a stream keeps a window's state until
    its watermark passes, and leaves out what comes after that."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.unix_micros("w.start").alias("window_us"), "n")


def run_counts(spark: SparkSession, stream: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """All that the stream has now. Each micro-batch writes the windows that it changed as Parquet, by its own
    number, so one that runs twice writes the same; a window's last count stands. Nothing gathers on the driver."""
    folder = shared_folder(spark, "windows")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    running = windowed_counts(stream, width, late).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start()
    running.awaitTermination()
    written = spark.read.schema("event_type string, window_us bigint, n bigint, batch bigint").parquet(f"{folder}/out")
    return written.groupBy("event_type", "window_us").agg(F.max_by("n", "batch").alias("n"))


def hourly_counts(spark: SparkSession, file: str) -> DataFrame:
    """All of one file's events through a stream that ends when they are read."""
    folder, name = os.path.split(file)
    return run_counts(spark, spark.readStream.schema(spark.read.parquet(file).schema).option("pathGlobFilter", name).parquet(folder))
