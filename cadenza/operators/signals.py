"""Array operators on samples: filters, band power, envelopes, resampling, spectra.

Short arrays go through higher-order functions. Recursive filters over long ones are an Arrow function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def high_pass(rate: float, hz: float, q: float) -> tuple[float, float, float, float, float]:
    """Second-order coefficients (b0, b1, b2, a1, a2), normalised by a0, after the audio EQ cookbook."""
    w = 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return tuple(v / (1 + alpha) for v in ((1 + c) / 2, -(1 + c), (1 + c) / 2, -2 * c, 1 - alpha))


def low_pass(rate: float, hz: float, q: float) -> tuple[float, float, float, float, float]:
    w = 2 * math.pi * hz / rate
    c, alpha = math.cos(w), math.sin(w) / (2 * q)
    return tuple(v / (1 + alpha) for v in ((1 - c) / 2, 1 - c, (1 - c) / 2, -2 * c, 1 - alpha))


def high_shelf(rate: float, hz: float, q: float, gain_db: float) -> tuple[float, float, float, float, float]:
    a, w = 10 ** (gain_db / 40), 2 * math.pi * hz / rate
    c, beta = math.cos(w), 2 * math.sqrt(a) * math.sin(w) / (2 * q)
    a0 = (a + 1) - (a - 1) * c + beta
    b = (a * ((a + 1) + (a - 1) * c + beta), -2 * a * ((a - 1) + (a + 1) * c), a * ((a + 1) + (a - 1) * c - beta))
    return tuple(v / a0 for v in (*b, 2 * ((a - 1) - (a + 1) * c), (a + 1) - (a - 1) * c - beta))


def biquad(samples: Column, coefficients: tuple[float, ...]) -> Column:
    """Direct form I, as a fold that carries two inputs and two outputs."""
    b0, b1, b2, a1, a2 = coefficients
    zero = F.lit(0.0)
    start = F.struct(zero.alias("x1"), zero.alias("x2"), zero.alias("y1"), zero.alias("y2"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(s: Column, v: Column) -> Column:
        x = v.cast("double")
        y = b0 * x + b1 * s["x1"] + b2 * s["x2"] - a1 * s["y1"] - a2 * s["y2"]
        return F.struct(x.alias("x1"), s["x1"].alias("x2"), y.alias("y1"), s["y1"].alias("y2"), F.concat(s["out"], F.array(y)).alias("out"))

    return F.aggregate(samples, start, step, lambda s: s["out"])


def biquad_long(coefficients: tuple[float, ...]):
    """The same filter as an Arrow function, for arrays too long for a fold that copies its output."""
    b0, b1, b2, a1, a2 = coefficients

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        out = []
        for x in samples:
            y, x1, x2, y1, y2 = np.empty(len(x)), 0.0, 0.0, 0.0, 0.0
            for i, v in enumerate(np.asarray(x, float)):
                now = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
                x1, x2, y1, y2, y[i] = v, x1, now, y1, now
            out.append(y)
        return pd.Series(out)

    return run


def _dot(samples: Column, wave) -> Column:
    return F.aggregate(F.zip_with(samples, F.array(*map(F.lit, wave)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)


def dft_power(samples: Column, size: int, bin: int) -> Column:
    """Power of one bin of the discrete Fourier transform of arrays of a known size, without a window."""
    angle = [2 * math.pi * bin * i / size for i in range(size)]
    re, im = _dot(samples, [math.cos(a) for a in angle]), _dot(samples, [-math.sin(a) for a in angle])
    return (re * re + im * im) / size


def band_power_db(samples: Column, size: int, bands: list[tuple[int, int]]) -> Column:
    """array: 10 log10 of the mean power of the bins of each band [first, last]."""
    means = [sum((dft_power(samples, size, k) for k in range(a, b + 1)), F.lit(0.0)) / (b - a + 1) for a, b in bands]
    return F.array(*(10 * F.log10(m + 1e-30) for m in means))


def sibilance(low: Column, high: Column) -> Column:
    """How far high bands stand over middle ones, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (high - low + 1) / 9))


def envelope(samples: Column, width: int) -> Column:
    """Mean of absolute values of consecutive groups of `width` samples; the last group may be shorter."""
    many = F.ceil(F.size(samples) / width).cast("int")
    part = F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.slice(samples, k * width + 1, F.lit(width)))
    mean = F.transform(part, lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + F.abs(v.cast("double"))) / F.size(p))
    return F.when(many > 0, mean).otherwise(F.expr("cast(array() as array<double>)"))


def to_mono(samples: Column, channels: int) -> Column:
    frames = F.floor(F.size(samples) / channels).cast("int")
    mean = F.transform(F.sequence(F.lit(0), frames - 1), lambda i: F.aggregate(F.slice(samples, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda s, v: s + v.cast("double")) / channels)
    return F.when(frames > 0, mean).otherwise(F.expr("cast(array() as array<double>)"))


def resample(rate_in: float, rate_out: float):
    """Linear interpolation to another rate, as an Arrow function."""

    @F.pandas_udf("array<double>")
    def run(samples: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)
            n = int(len(x) * rate_out / rate_in)
            return np.interp(np.arange(n) * rate_in / rate_out, np.arange(len(x)), x) if len(x) else x

        return samples.map(one)

    return run


def apply_gain(samples: Column, gains_db: Column, frame: int) -> Column:
    """Samples times their frame's gain, interpolated between the frames' middles."""
    last = F.size(gains_db)

    def gain(i: Column) -> Column:
        at = F.greatest(F.lit(0.0), F.least((last - 1).cast("double"), (i + 0.5) / frame - 0.5))
        k = F.floor(at).cast("int")
        low, high = F.element_at(gains_db, k + 1), F.element_at(gains_db, F.least(k + 2, last))
        return F.pow(F.lit(10.0), (low + (high - low) * (at - k)) / 20)

    return F.transform(samples, lambda v, i: v * gain(i))
