"""Protecting quiet speech: a model's speech probabilities may add frames to an energy mask, never take any.

Frames of a report are taken over only where they lie on the planner's own grid; anything off it, in the whole range,
leaves the energy mask as it is. Runs of frames that only the model calls speech are added where they close a gap
between energetic ones or, if shorter and surer, hang on one side. All of it is joins and windows on frame numbers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators import runs

#: Probabilities, lengths in milliseconds, and how far off its grid a frame may be (of a frame).
LEAST, LEAST_ONE_SIDED, ONE_SIDED_MS, GAP_MS, SLACK = 0.58, 0.72, 160.0, 260.0, 0.25


def on_grid(start: Column, end: Column, index: Column, frame_ms: float) -> Column:
    good = sc.is_finite(start) & sc.is_finite(end) & (F.abs(start - index * frame_ms) <= frame_ms * SLACK) & (F.abs(end - (index + 1) * frame_ms) <= frame_ms * SLACK)
    return F.coalesce(good, F.lit(False))


def planner_frames(mask: DataFrame, report: DataFrame, reports: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """mask (keys, range_start_sec, frame_idx from 0, energy) with probability, null in all frames of a range that does not fit.

    report: keys, frame, start_ms, end_ms, probability; reports, one row a source: keys, frame_ms, frames, duration_ms.
    A range fits if it starts on the grid (to a quarter of a frame), ends within the report and its source (to a frame),
    and every frame is there, on the grid, with a probability from 0 to 1. A key without a report does not fit.
    """
    exact = F.col("range_start_sec") * 1000 / frame_ms
    first = sc.half_up(exact).cast("long")
    d = mask.withColumn("__first", first).join(reports.select(*keys, F.col("frame_ms").alias("__ms"), F.col("frames").alias("__many"), F.col("duration_ms").alias("__long")), keys, "left")
    grid = sc.is_finite(F.col("range_start_sec")) & (F.col("range_start_sec") >= 0) & (F.abs(exact - first) <= SLACK) & (F.abs(F.col("__ms") - frame_ms) <= 0.001)
    d = d.withColumn("__frame", F.col("__first") + F.col("frame_idx"))
    known = report.select(*keys, F.col("frame").alias("__frame"), "start_ms", "end_ms", F.col("probability").alias("__p"))
    d = d.join(known, [*keys, "__frame"], "left")
    p = F.col("__p")
    here = on_grid(F.col("start_ms"), F.col("end_ms"), F.col("__frame"), frame_ms) & sc.is_finite(p) & p.between(0, 1)
    w = Window.partitionBy(*keys, "range_start_sec")
    end = F.max("__frame").over(w) + 1
    fits = F.coalesce(grid & (end <= F.col("__many")) & (end * frame_ms <= F.col("__long") + frame_ms), F.lit(False))
    whole = F.min(F.coalesce(here, F.lit(False)) & fits).over(w)
    return d.select(*mask.columns, F.when(whole, p).alias("probability"))


def protect(frames: DataFrame, keys: list[str], frame_ms: float, energy: str = "energy", probability: str = "probability", least: float = LEAST, one_sided: float = LEAST_ONE_SIDED, island_ms: float = ONE_SIDED_MS, gap_ms: float = GAP_MS) -> DataFrame:
    """frames (keys, frame_idx, ...) with protected, added and isolated (frames that only the model calls speech and that stay out).

    A null probability is none.
    """
    short = max(1, math.floor(island_ms / frame_ms + 0.5))
    gap = max(short, math.floor(gap_ms / frame_ms + 0.5))
    p = F.coalesce(F.col(probability), F.lit(0.0))
    d = frames.withColumn("__model", ~F.col(energy) & (p >= min(0.99, max(0.01, least))))
    d = runs.with_run_id(d, keys, "__model", out="__run")
    series, run = Window.partitionBy(*keys).orderBy("frame_idx"), Window.partitionBy(*keys, "__run")
    beside = lambda f: F.coalesce(f(energy).over(series), F.lit(False))
    d = d.withColumn("__before", beside(F.lag)).withColumn("__after", beside(F.lead))
    left, right = F.max_by("__before", -F.col("frame_idx")).over(run), F.max_by("__after", "frame_idx").over(run)
    size, sure = F.count("*").over(run), F.min(p).over(run) >= min(0.99, max(least, one_sided))
    d = d.withColumns({"__left": left, "__right": right, "__size": size, "__sure": sure})
    attached = F.when(F.col("__left") & F.col("__right"), F.col("__size") <= gap).otherwise((F.col("__left") | F.col("__right")) & (F.col("__size") <= short) & F.col("__sure"))
    added = F.col("__model") & attached
    return d.select(*frames.columns, (F.col(energy) | added).alias("protected"), added.alias("added"), (F.col("__model") & ~attached).alias("isolated"))


def ranges(protected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reason, added, isolated: a range to which nothing was added goes the way it went without a model."""
    d = protected.groupBy(*keys).agg(F.sum(F.col("added").cast("long")).alias("added"), F.sum(F.col("isolated").cast("long")).alias("isolated"))
    helped = F.col("added") > 0
    return d.select(*keys, F.when(helped, "ml-protection").otherwise("legacy-fallback").alias("reason"), "added", F.when(helped, F.col("isolated")).otherwise(0).alias("isolated"))
