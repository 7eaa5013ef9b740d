"""Structured Streaming over append-only event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files under ``path``, in the order they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def without_repeats(events: DataFrame, key: str, time: str, delay: str = "30 days") -> DataFrame:
    """Each event once: repeats within ``delay`` of the watermark are dropped, and the state for them is let go."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest_states(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """The last value of each key so far (update or complete mode): a running fold of the log."""
    return events.where(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.max_by(value, F.struct(*order)).alias("state"), F.count("*").alias("n_events"))


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "1 day", delay: str = "30 days") -> DataFrame:
    """Events of each kind in each window, final once the watermark has passed (append mode)."""
    counted = events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start a query that takes what is there and stops; exactly once through its checkpoint."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        return writer.format("parquet").option("path", path).start()
    return writer.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")).start()
