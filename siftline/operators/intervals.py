"""Unions of intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, start, end): overlapping and adjoining intervals of whole numbers made one, for each key."""
    w = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = df.select(key, start, end).distinct().withColumn("__new", F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0))
    island = opened.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def years(ranges: DataFrame, key: str) -> DataFrame:
    """(key, years, islands) of (key, start_month, end_month): months of the union in years to one decimal, halves to the even one."""
    u = merged(ranges, key, "start_month", "end_month")
    return u.groupBy(key).agg(F.bround(F.sum(F.col("end_month") - F.col("start_month") + 1) / 12, 1).alias("years"), F.count("*").alias("islands"))
