"""A monthly panel kept up to date from a stream of dated cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "45 days"


def monthly_counts(stream: DataFrame, district: str = "district", when: str = "case_date", watermark: str = WATERMARK) -> DataFrame:
    """(district, month, count) of a stream in update mode; cases later than the watermark are left out.

    The watermark is a duration; the lag in closed months is applied by the reader of the panel.
    """
    rows = stream.withColumn("_t", F.col(when).cast("timestamp")).withWatermark("_t", watermark)
    day = F.window("_t", "1 day")
    counted = rows.groupBy(F.col(district).alias("district"), day).agg(F.count(F.lit(1)).alias("count"))
    return counted.select("district", F.trunc(F.col("window.start"), "MM").alias("month"), F.to_date("window.start").alias("day"), "count")


def closed_panel(daily: DataFrame) -> DataFrame:
    """(district, month, count) from the sink of ``monthly_counts``: the last count of each day, summed."""
    last = daily.groupBy("district", "month", "day").agg(F.max("count").alias("count"))
    return last.groupBy("district", "month").agg(F.sum("count").alias("count"))
