"""Levels at which a render is delivered, the balance of its spectrum, and the size of its canonical file, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalar import clamp, is_finite, unit

# Decibels of the delivery rules, centres of a de-esser by placement, the header of a canonical file.
TARGET_OFFSET_DB, MOST_MAKEUP_DB = 1.35, 10.5
NOISE_BUDGET_DB, CLEAN_FLOOR_DB = 0.85, -60.0
DE_ESSER = {"low_center": (5800, 8200), "balanced": (6500, 9000), "high_center": (7200, 9800)}
WAV_HEADER_BYTES, FLOAT_BYTES = 44, 4


def makeup_db(target: Column, measured: Column) -> Column:
    """Gain from the measured level of speech to its target, never negative; 0 where either is missing."""
    gain = clamp(target + TARGET_OFFSET_DB - measured, 0.0, MOST_MAKEUP_DB)
    return F.when(is_finite(target) & is_finite(measured), gain).otherwise(0.0)


def noise_lane_db(requested: Column, source_floor: Column, source_confidence: Column, floor: Column, confidence: Column) -> Column:
    """The requested gain, drawn toward the headroom over the noise floor as far as both floors are trusted."""
    allowed = F.greatest(F.lit(CLEAN_FLOOR_DB), source_floor + NOISE_BUDGET_DB)
    limit = F.least(requested, F.greatest(F.lit(0.0), allowed - floor))
    return requested + F.sqrt(unit(source_confidence) * unit(confidence)) * (limit - requested)


def frame_range(start: Column, seconds: Column, frame_ms: Column, total: Column) -> Column:
    """Frames of a stretch with a guard frame on either side, and the start's place among them: frame_start, frame_end, offset.

    All 0 where a measure is missing or not positive; an empty range at the end where the stretch starts beyond it.
    """
    known = is_finite(start) & is_finite(seconds) & is_finite(frame_ms) & is_finite(total)
    known = known & (frame_ms > 0) & (total > 0) & (seconds > 0)
    count, from_ = F.floor(total), F.greatest(F.lit(0.0), start)
    at = from_ * 1000 / F.when(frame_ms > 0, frame_ms)
    first = F.greatest(F.lit(0), F.floor(at) - 1)
    last = F.greatest(F.lit(0), F.least(count, F.ceil((from_ + seconds) * 1000 / F.when(frame_ms > 0, frame_ms) - 0.5) + 1))

    def made(a: Column, b: Column, offset: Column) -> Column:
        return F.struct(a.cast("long").alias("frame_start"), b.cast("long").alias("frame_end"), offset.cast("double").alias("offset"))

    zero = F.lit(0)
    return F.when(~known, made(zero, zero, zero)).when(at >= count, made(count, count, zero)).otherwise(made(first, last, at - first))


def _mean_power_db(bands: Column) -> Column:
    power = F.aggregate(bands, F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x / 10))
    return F.when(F.forall(bands, is_finite), 10 * F.log10(power / F.size(bands) + 1e-30))


def tilts_db(bands: Column) -> Column:
    """low and high tilt of eight bands against the middle three; null for fewer bands or one that is not finite."""
    low, middle, high = (_mean_power_db(F.slice(bands, a, n)) for a, n in ((1, 3), (4, 3), (7, 2)))
    whole = (F.size(bands) >= 8) & low.isNotNull() & middle.isNotNull() & high.isNotNull()
    return F.when(whole, F.struct((low - middle).alias("low"), (high - middle).alias("high")))


def de_esser_placement(bands: Column) -> Column:
    """Name of the placement in DE_ESSER by which of the two upper bands stands out by 2 dB; balanced for fewer bands."""
    bias = F.get(bands, F.lit(7)) - F.get(bands, F.lit(6))
    return F.when(F.size(bands) < 8, "balanced").when(bias >= 2, "high_center").when(bias <= -2, "low_center").otherwise("balanced")


def _not_negative(x: Column) -> Column:
    return F.when(is_finite(x), F.greatest(F.lit(0.0), x)).otherwise(0.0)


def wav_bytes(seconds: Column, sample_rate: Column) -> Column:
    """Bytes of a mono file of 32-bit floats; what is not finite counts as 0, a rate as at least 1."""
    rate = F.greatest(F.lit(1), F.floor(_not_negative(sample_rate)))
    return WAV_HEADER_BYTES + F.ceil(_not_negative(seconds) * rate) * FLOAT_BYTES


def needs_windows(seconds: Column, rendered: Column, companion: Column, least_seconds: float, least_bytes: float, least_combined: float) -> Column:
    """Whether a file is to be analysed in windows: by its duration, its bytes, or those of both files."""
    seconds, rendered, companion = map(_not_negative, (seconds, rendered, companion))
    return (seconds >= least_seconds) | (rendered >= least_bytes) | (rendered + companion >= least_combined)
