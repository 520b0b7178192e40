"""An extension: daily detections of a stream of scenes. The blueprint itself has batch queries only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_detections(scenes: DataFrame, least: float, late: str = "2 days") -> DataFrame:
    """Detections by ``day`` and ``cell`` of a batch or a stream (``ts``, ``cell``, ``value``); state is dropped once the watermark has passed a day."""
    timed = scenes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "cell").agg(F.count_if(F.col("value") >= least).alias("detections")).select(F.col("w.start").alias("day"), "cell", "detections")
