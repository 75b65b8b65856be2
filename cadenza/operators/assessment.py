"""Per-file decisions from measured columns: risks, needs, weights, targets; and per-run shape scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.percentiles import linear
from cadenza.functions.scalar import clamp, unit

ROOM = ("low", "medium", "high")


def noise_risk(noise_floor: Column, near_floor: Column, threshold: Column) -> Column:
    """low / medium / high from the worse of two floors, raised where the speech threshold itself is high."""
    floor = F.greatest(F.coalesce(noise_floor, F.lit(-70.0)), F.coalesce(near_floor, F.lit(-90.0)))
    known = noise_floor.isNotNull() | near_floor.isNotNull()
    speech = F.coalesce(threshold, clamp(floor + 10.5, -58.0, -26.0))
    first = F.when(known & (floor > -52), 2).when(known & (floor > -62), 1).otherwise(0)
    second = F.when((first == 0) & (speech > -44), 1).otherwise(first)
    return F.element_at(F.array(*map(F.lit, ROOM)), F.when((second == 1) & (speech > -40), 2).otherwise(second) + 1)


def room_risk(score: Column, confidence: Column) -> Column:
    """low / medium / high; one step down where the analysis is not to be relied on."""
    c = F.coalesce(confidence, F.lit(0.25))
    scaled = F.coalesce(score, F.lit(0.0)) * clamp(0.75 + 0.25 * c, 0.75, 1.0)
    level = F.when(scaled < 0.33, 0).when(scaled < 0.58, 1).otherwise(2)
    return F.element_at(F.array(*map(F.lit, ROOM)), F.when(c < 0.35, F.greatest(F.lit(0), level - 1)).otherwise(level) + 1)


def line_continuity(instability, swing, jump, onset, sag, end_fade) -> Column:
    return unit(0.24 * instability + 0.22 * swing + 0.22 * jump + 0.14 * onset + 0.10 * sag + 0.08 * end_fade)


def leveling(peak: Column, loudness_range: Column, range_gap: Column, dynamics: float = 1.0) -> tuple[Column, Column]:
    """(emotion protection, levelling need) from the true peak, the loudness range and its gap to the batch's."""
    hot, dynamic = unit((F.coalesce(peak, F.lit(-9.0)) + 9) / 7), unit((loudness_range - 5.5) / 7)
    return clamp((0.48 * hot + 0.4 * dynamic) * dynamics, 0.0, 0.82), unit((0.72 * dynamic + F.greatest(F.lit(0.0), range_gap) / 8) * dynamics)


def reference_weight(confidence: Column, room: Column, echo: Column, pause: Column, compression: Column) -> Column:
    """How much a file counts in the batch's reference; missing penalties count as none."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    trust = unit(F.coalesce(confidence, F.lit(0.35)))
    return unit(trust - clamp(0.5 * zero(room) + 0.35 * zero(echo), 0.0, 0.85) - clamp(0.45 * zero(pause), 0.0, 0.45) - clamp(0.35 * zero(compression), 0.0, 0.35))


def reference_repeats(weight: Column) -> Column:
    return F.when(weight < 0.2, 0).when(weight >= 0.75, 3).when(weight >= 0.45, 2).otherwise(1)


def alignment_confidence(best: Column, second: Column) -> Column:
    return unit((best - F.greatest(F.lit(0.0), second)) * 3 + best * 0.35)


def review_confidence(gap: Column, failed: Column, critical: Column, challenger: Column) -> Column:
    """Of a verdict; a gap is 0.14 where there is no rival."""
    one = lambda x: x.cast("int")
    return clamp(0.45 + 0.22 * F.coalesce(gap, F.lit(0.14)) + 0.14 * one(failed) + 0.12 * one(critical) + 0.08 * one(challenger), 0.3, 0.97)


def click_score(pause_density: Column, speech_density: Column, per_minute: Column) -> Column:
    return unit(1.45 * pause_density + 0.55 * speech_density + per_minute / 30)


def trimmed_target(runs: DataFrame, keys: list[str], level: str, base: float, blend: float, out: str) -> DataFrame:
    """Per group a level between `base` and the mean without the 15 % at either end (from 7 runs), within 3 of base."""
    w = Window.partitionBy(*keys)
    d = runs.withColumn("__n", F.count(level).over(w)).withColumn("__i", F.row_number().over(w.orderBy(level)))
    trim = F.when(F.col("__n") >= 7, F.greatest(F.lit(1), F.floor(F.col("__n") * 0.15))).otherwise(0)
    kept = d.where((F.col("__i") > trim) & (F.col("__i") <= F.greatest(trim + 1, F.col("__n") - trim)))
    return kept.groupBy(*keys).agg(clamp(blend * F.avg(level) + (1 - blend) * base, base - 3, base + 3).alias(out))


def run_shape(frames: DataFrame, keys: list[str], db: str, start: str, end: str, scale: int = 10) -> DataFrame:
    """Per run: sag of the middle third under the outer ones, and the onset over the body, as scores from 0 to 1.

    frames carry each frame's run bounds; `scale` shrinks the frame counts for coarser series.
    """
    at, length = F.col("frame_idx") - F.col(start), F.col(end) - F.col(start)
    third = F.floor(at * 3 / length)
    mean = lambda c: F.avg(F.when(c, F.col(db)))
    sag = unit(((mean(third == 0) + mean(third == 2)) / 2 - mean(third == 1) - 1.8) / 4.2)
    onset = unit((mean(at < 12 // scale + 1) - mean(at >= 25 // scale) - 2.5) / 4.5)
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.coalesce(sag, F.lit(0.0)).alias("sag"), F.coalesce(onset, F.lit(0.0)).alias("onset"))


def dropout_frames(frames: DataFrame, keys: list[str], source: str, rendered: str, window: int) -> DataFrame:
    """frames with `bad`: the render fell silent where the source had sound, outright or against its own recent past."""
    recent = F.percentile(rendered, F.lit(0.5)).over(Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-window, 0))
    s, x = F.col(source), F.col(rendered)
    return frames.withColumn("bad", ((x <= -68) & (s >= -50)) | ((x - s <= -24) & (x <= -58) & (x <= recent - 18)) | ((s >= -38) & (x <= -54)))


def dropout_severe(bad_seconds: Column, longest: Column, clusters: Column) -> Column:
    return (bad_seconds >= 0.35) | (longest >= 0.18) | ((clusters >= 3) & (bad_seconds >= 0.24))


def expressive_threshold(contrast: Column) -> Column:
    """Aggregate: the contrast from which a frame is an expressive event."""
    return F.greatest(F.lit(2.5), F.coalesce(linear(F.when(contrast > 0, contrast), 0.9), F.lit(2.5)))
