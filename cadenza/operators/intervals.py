"""Half-open intervals [start, end) per key: union, complement, overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import overlap


def merge(df: DataFrame, keys: list[str], start: str, end: str, gap: float = 0.0) -> DataFrame:
    """Union of the intervals of a key; those at most `gap` apart become one. keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = df.select(*keys, start, end, F.when(F.col(start) > reach + gap, 1).otherwise(0).alias("__new"))
    d = d.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "__id").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__id")


def complement(merged: DataFrame, bounds: DataFrame, keys: list[str], start: str, end: str, least: float = 0.0) -> DataFrame:
    """What merged intervals leave of [low, high) of bounds (keys, low, high), if at least `least` long."""
    points = merged.select(*keys, F.col(start).alias("__a"), F.col(end).alias("__b"))
    points = points.unionByName(bounds.select(*keys, F.col("high").alias("__a"), F.col("high").alias("__b")))
    w = Window.partitionBy(*keys).orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)
    free = points.withColumn("__from", F.max("__b").over(w)).join(bounds, keys)
    out = free.select(*keys, F.greatest(F.coalesce("__from", "low"), "low").alias(start), F.least("__a", "high").alias(end))
    return out.where((F.col(end) > F.col(start)) & (F.col(end) - F.col(start) >= least))


def occupancy(windows: DataFrame, spans: DataFrame, keys: list[str], window_id: str, bucket: float) -> DataFrame:
    """Share of each window (w_start, w_end) that spans (s_start, s_end) of its key cover.

    Both sides are dealt to time buckets, so the join is on equal buckets instead of a range; a pair counts in the
    bucket where the later of the two starts.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket).cast("long"), F.floor(F.col(b) / bucket).cast("long"))).alias("__cell")
    left, right = windows.select(*windows.columns, cells("w_start", "w_end")), spans.select(*keys, "s_start", "s_end", cells("s_start", "s_end"))
    pairs = left.join(right, [*keys, "__cell"]).where(F.floor(F.greatest("w_start", "s_start") / bucket) == F.col("__cell"))
    shared = pairs.groupBy(*keys, window_id).agg(F.sum(overlap(*(F.col(c) for c in ("w_start", "w_end", "s_start", "s_end")))).alias("__shared"))
    out = windows.join(shared, [*keys, window_id], "left")
    length = F.col("w_end") - F.col("w_start")
    return out.select(*windows.columns, F.when(length > 0, F.coalesce("__shared", F.lit(0.0)) / length).otherwise(0.0).alias("occupancy"))
