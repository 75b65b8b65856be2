"""Runs and clusters of ordered frames (gaps and islands). Everything stays in windows over (keys, frame_idx)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_run_id(df: DataFrame, keys: list[str], flag: str, order: str = "frame_idx", out: str = "run_id") -> DataFrame:
    """df with the number of the maximal run of equal flags that each frame belongs to, from 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag(flag).over(w).isNull() | (F.lag(flag).over(w) == F.col(flag)), 0).otherwise(1)
    return df.withColumn("__change", change).withColumn(out, F.sum("__change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__change")


def runs(df: DataFrame, keys: list[str], flag: str, *aggs: Column, order: str = "frame_idx") -> DataFrame:
    """keys, run_id, flag, start_frame, end_frame (exclusive), frames, and further aggregates of each run."""
    ends = (F.min(order).alias("start_frame"), (F.max(order) + 1).alias("end_frame"), F.count("*").alias("frames"))
    return with_run_id(df, keys, flag, order).groupBy(*keys, "run_id", flag).agg(*ends, *aggs)


def drop_short(df: DataFrame, keys: list[str], flag: str, least: int, order: str = "frame_idx") -> DataFrame:
    """Runs of true shorter than `least` become false."""
    d = with_run_id(df, keys, flag, order, "__run")
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    return d.withColumn(flag, F.col(flag) & (size >= least)).drop("__run")


def bridge_gaps(df: DataFrame, keys: list[str], flag: str, most: int, order: str = "frame_idx") -> DataFrame:
    """Gaps of at most `most` frames between two runs of true become true; those at the edges stay."""
    d = with_run_id(df, keys, flag, order, "__run")
    size = F.count("*").over(Window.partitionBy(*keys, "__run"))
    last = F.max("__run").over(Window.partitionBy(*keys))
    inner = (F.col("__run") > 0) & (F.col("__run") < last)
    return d.withColumn(flag, F.col(flag) | (inner & (size <= most))).drop("__run")


def finalize_mask(df: DataFrame, keys: list[str], flag: str, least: int, most_gap: int, order: str = "frame_idx") -> DataFrame:
    """First short runs go, then gaps close. The other order gives other masks."""
    return bridge_gaps(drop_short(df, keys, flag, least, order), keys, flag, most_gap, order)


def gap_clusters(df: DataFrame, keys: list[str], index: str, most_gap: int, *aggs: Column) -> DataFrame:
    """Clusters of sorted indices whose steps are at most `most_gap`: keys, cluster_id, first, last, members."""
    w = Window.partitionBy(*keys).orderBy(index)
    new = F.when(F.col(index) - F.lag(index).over(w) > most_gap, 1).otherwise(0)
    d = df.withColumn("__new", new).withColumn("cluster_id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = (F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("members"))
    return d.groupBy(*keys, "cluster_id").agg(*ends, *aggs)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle as well."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
