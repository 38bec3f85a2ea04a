"""Extension beyond the batch engine: sums by designation set kept fresh from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window, with a watermark for late ones; works on a stream and on a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def merge_sums(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sums by set after new segments: both are added up by set, so a batch is merged in one shuffle."""
    both = known.select("refs", "n", "km", "arcs").unionByName(fresh.select("refs", "n", "km", "arcs"))
    return both.groupBy("refs").agg(F.max("n").alias("n"), F.sum("km").cast("decimal(18,2)").alias("km"), F.sum("arcs").alias("arcs"))


def keep_sums(stream: DataFrame, roll_up, path: str, checkpoint: str):
    """Write each micro-batch's own sums under its number; a batch that is run again replaces its own folder only."""

    def save(batch: DataFrame, number: int) -> None:
        roll_up(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).start()
