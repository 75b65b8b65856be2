"""Summaries of series: their speech map, how much a level moves, and the size of a bundle of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import runs


def speech_map(frames: DataFrame, by: list[str], mask: str, frame_seconds: float) -> DataFrame:
    """Per series: share of speech, runs of speech and their median length, long silences, and whether it is long and sparse.

    Long and sparse: 480 s or more, at most 38 % speech, and a dozen silences of 1.5 s or runs of 2.6 s at the median.
    """
    spans = runs.runs(frames, by, mask).withColumn("seconds", F.col("frames") * F.lit(frame_seconds))
    on, off = F.when(F.col(mask), F.col("seconds")), F.when(~F.col(mask), F.col("seconds"))
    out = spans.groupBy(*by).agg(
        F.sum("seconds").alias("seconds"), (100 * F.coalesce(F.sum(on), F.lit(0.0)) / F.greatest(F.sum("seconds"), F.lit(1e-6))).alias("duty_pct"), F.count(on).alias("n_speech"),
        F.coalesce(F.median(on * 1000), F.lit(0.0)).alias("median_run_ms"), F.count(F.when(off * 1000 >= 1500, 1)).alias("long_silences"),
    )
    sparse = (F.col("seconds") >= 480) & (F.col("duty_pct") <= 38) & ((F.col("long_silences") >= 12) | (F.col("median_run_ms") <= 2600))
    return out.withColumn("long_sparse", sparse)


def motion(frames: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """Per series: steps of a level from frame to frame (median, upper percentiles, the most), and the mean reliability
    of its frames, which falls off around -100 dB. Series of one frame have no steps and are left out."""
    step = F.abs(F.col(level) - F.lag(level).over(Window.partitionBy(*by).orderBy(order)))
    at = lambda q: F.percentile("__step", F.lit(q))
    out = frames.withColumn("__step", step).groupBy(*by).agg(
        F.count("__step").alias("transitions"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.max("__step").alias("most"), F.avg(reliability(F.col(level))).alias("reliability"),
    )
    return out.where("transitions > 0")


def reliability(db: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (-100 - db) / 6))


def bundle_bytes(size: Column, name: Column) -> Column:
    """Aggregate: bytes of a bundle, its files and an entry for each name."""
    return F.sum(F.greatest(F.lit(0.0), F.coalesce(size, F.lit(0.0)))) + 4096 + F.sum(128 + 2 * F.length(name))
