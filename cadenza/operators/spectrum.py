"""Spectra of frames of 20 ms in logarithmic bands: which frames are heard, their band powers, averages, sibilance, tone.

Frames are rows (keys, frame_idx from 0, samples of a known size); one matrix product a batch gives the powers of all
bands of all its frames. Which frames count is decided by ranks in windows, so a series of any length is spread.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators.signals import sibilance

C = F.col
#: Band centres, their width in octaves, points in a band, frames at most, the level under which a frame is silent.
BANDS, WIDTH, POINTS = (60, 120, 250, 500, 1000, 2000, 4000, 8000), 0.7, 5
MOST_FRAMES, MOST_EVENT_FRAMES, SILENT, NOTHING = 1600, 240, 1e-4, -120.0
MOST_AUTHORITY, MAIN_CUT, SECOND_CUT = 0.5, -4.0, -2.4


def frame_size(rate: int) -> int:
    return max(32, math.floor(rate * 0.02 + 0.5))


def probes(rate: int, bands: tuple = BANDS, width: float = WIDTH) -> np.ndarray:
    """(bands, POINTS) frequencies, evenly from a band's lower to its upper end, which stays under half the rate."""
    low = np.maximum(20, np.array(bands) * 2 ** (-width / 2))
    high = np.minimum(rate / 2 - 10, np.array(bands) * 2 ** (width / 2))
    return low[:, None] + (high - low)[:, None] * np.arange(POINTS) / (POINTS - 1)


def band_powers(samples: Column, rate: int, bands: tuple = BANDS, width: float = WIDTH) -> Column:
    """struct<powers array<double>, rms>: mean power at the points of each band under a Hann window, and the frame's rms.

    Both are null for a null frame, one of another size, or one that holds a value that is null or not finite.
    """
    n = frame_size(rate)
    at = np.arange(n)
    hann = 0.5 * (1 - np.cos(2 * math.pi * at / (n - 1)))
    waves = hann[:, None] * np.exp(2j * math.pi * at[:, None] * probes(rate, bands, width).ravel() / rate)

    @F.pandas_udf("struct<powers:array<double>,rms:double>")
    def run(samples: pd.Series) -> pd.DataFrame:
        x, good = np.zeros((len(samples), n)), np.zeros(len(samples), bool)
        for k, v in enumerate(samples):
            if v is not None and len(v) == n:
                x[k] = np.asarray(v, float)
                good[k] = np.isfinite(x[k]).all()
        x[~good] = 0
        powers = (np.abs(x @ waves) ** 2).reshape(len(x), len(bands), POINTS).mean(axis=2) / n**2
        rms = np.sqrt((x**2).mean(axis=1))
        return pd.DataFrame({"powers": pd.Series([p if g else None for p, g in zip(powers, good)], dtype=object), "rms": pd.Series([float(v) if g else None for v, g in zip(rms, good)], dtype=object)})

    return run(samples)


def overlapping(frames: DataFrame, activity: DataFrame, keys: list[str], rate: int, activity_ms: float, flag: str = "active") -> DataFrame:
    """frames with `heard`: whether an active frame of another cadence (keys, activity_idx, flag) overlaps the frame."""
    ms = frame_size(rate) * 1000 / rate
    first, last = F.floor(C("frame_idx") * ms / activity_ms), F.ceil((C("frame_idx") + 1) * ms / activity_ms) - 1
    cells = frames.select(*keys, "frame_idx", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("activity_idx"))
    hits = cells.join(activity.where(C(flag)).select(*keys, "activity_idx"), [*keys, "activity_idx"]).select(*keys, "frame_idx").distinct().withColumn("heard", F.lit(True))
    return frames.join(hits, [*keys, "frame_idx"], "left").withColumn("heard", F.coalesce("heard", F.lit(False)))


def _ranked(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames with the place of each heard frame among them (from 0), and how many there are, and of all frames."""
    w = Window.partitionBy(*keys)
    d = frames.withColumn("__at", F.sum(C("heard").cast("long")).over(w.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return d.withColumn("__heard", F.sum(C("heard").cast("long")).over(w)).withColumn("__all", F.count("*").over(w))


def log_band_spectrum(frames: DataFrame, keys: list[str], rate: int, most: int = MOST_FRAMES) -> DataFrame:
    """keys, band_db array<double>, counted, gated: mean level of each band over at most `most` heard frames (every n-th).

    Frames under the silent level do not count. Where no heard frame counts, every n-th of all frames stands in; where
    none of these does, all bands are at -120 dB.
    """
    d = _ranked(frames, keys)
    stride = lambda n: F.greatest(F.lit(1), F.ceil(n / most))
    gated = C("heard") & (C("__at") % stride(C("__heard")) == 0) & (C("__at") / stride(C("__heard")) < most)
    d = d.withColumn("__gated", gated).withColumn("__plain", C("frame_idx") % stride(C("__all")) == 0)
    every = d.select(*keys).distinct()
    d = d.where("__gated or __plain").withColumn("__b", band_powers(C("samples"), rate)).where(C("__b.rms") >= SILENT)
    means = lambda flag: F.array(*(F.avg(F.when(C(flag), C("__b.powers")[k])) for k in range(len(BANDS))))
    sums = d.groupBy(*keys).agg(means("__gated").alias("__g"), F.count_if("__gated").alias("__ng"), means("__plain").alias("__p"), F.count_if("__plain").alias("__np"))
    use = F.coalesce(C("__ng"), F.lit(0)) > 0
    db = F.transform(F.when(use, C("__g")).otherwise(C("__p")), lambda p: 10 * F.log10(p + 1e-30))
    counted = F.coalesce(F.when(use, C("__ng")).otherwise(C("__np")), F.lit(0))
    quiet = F.array_repeat(F.lit(NOTHING), len(BANDS))
    out = every.join(sums, keys, "left")
    return out.select(*keys, F.when(counted > 0, db).otherwise(quiet).alias("band_db"), counted.alias("counted"), use.alias("gated"))


def event_sibilance(frames: DataFrame, keys: list[str], rate: int, most: int = MOST_EVENT_FRAMES) -> DataFrame:
    """keys, authority: root mean square of the sibilance of at most `most` heard frames, evenly over all of them, up to 0.5.

    Silent and unusable frames count as 0. A series without a heard frame has none, whatever else is in it.
    """
    d = _ranked(frames, keys)
    p, n = C("__at"), C("__heard")
    place = lambda k: sc.half_up(k * (n - 1) / (most - 1)) if most > 1 else F.floor((n - 1) / 2)
    near = F.floor(p * (most - 1) / F.greatest(n - 1, F.lit(1)))
    even = (place(near) == p) | (place(near + 1) == p) if most > 1 else place(0) == p
    every = d.select(*keys).distinct()
    d = d.where(C("heard") & ((n <= most) | even)).withColumn("__b", band_powers(C("samples"), rate))
    level = lambda k: 10 * F.log10(C("__b.powers")[k] + 1e-30)
    score = sibilance((level(4) + level(5)) / 2, (level(6) + level(7)) / 2)
    squared = F.sum(F.when(C("__b.rms") >= SILENT, score * score).otherwise(0.0))
    found = d.groupBy(*keys).agg(F.least(F.lit(MOST_AUTHORITY), F.sqrt(squared / F.count("*"))).alias("authority"))
    return every.join(found, keys, "left").fillna(0.0, ["authority"])


def de_esser_cuts(score: Column) -> Column:
    """struct<main_db, second_db>: deeper with the square of the score, without a threshold; none for a null or NaN."""
    weight = F.coalesce(sc.unit(score), F.lit(0.0))
    return F.struct((weight * weight * MAIN_CUT + 0.0).alias("main_db"), (weight * weight * SECOND_CUT + 0.0).alias("second_db"))


def tone_delta(bands: Column, reference: Column, most: float = 3.0, house: tuple | None = None, blend: float = 0.0, priority: int | None = None, priority_most: float | None = None) -> Column:
    """By band, what brings the tone to a reference, the mean level apart: within `most`, and the `priority` largest within
    their own limit. blend mixes a house reference in."""
    blend = min(1.0, max(0.0, blend))
    first = max(0, priority if priority is not None else 2 if blend > 0 else 0)
    wide = priority_most if priority_most is not None else max(most, 3.0)
    n = F.least(F.size(bands), F.size(reference))
    cut = lambda a: F.slice(a, F.lit(1), n)
    target = cut(reference)
    if house and blend > 0:
        own = F.array(*map(F.lit, house))
        target = F.transform(target, lambda v, i: F.when(i < len(house), v * (1 - blend) + F.get(own, i) * blend).otherwise(v))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n
    offset = mean(target) - mean(cut(bands))
    raw = F.zip_with(target, cut(bands), lambda t, v: t - v - offset)
    order = F.array_sort(F.transform(raw, lambda v, i: F.struct((-F.abs(v)).alias("size"), i.alias("at"))))
    largest = F.transform(F.slice(order, 1, first), lambda s: s["at"]) if first else F.array().cast("array<int>")
    limit = lambda i: F.when(F.array_contains(largest, i), wide).otherwise(most)
    return F.transform(raw, lambda v, i: F.greatest(-limit(i), F.least(limit(i), v)))
