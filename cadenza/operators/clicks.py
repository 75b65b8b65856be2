"""Clicks: sample discontinuities that stand out from what is around them, found chunk by chunk.

Samples come as rows of consecutive chunks of any size. Every chunk is given the samples on both sides that its evidence
can reach, so tasks find candidates in parallel, and the same ones whatever the chunks are. Only the rest after a counted
click is sequential; it runs over the sparse candidates with the last click as its state.

A candidate is a step between two samples that is large against its frame and its neighbour frames, and either
* comes back within 4 ms, alone in its surroundings (a pulse),
* stands alone within 0.75 ms, or parts two levels, and has no like of itself within 30 ms (an edge), or
* parts two stretches of a periodic signal that agree with themselves but not with each other (a seam).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import sequential

#: The detector's limits.
LEAST_STEP, OVER_RMS, OVER_SHARP = 0.012, 1.35, 5.5
PULSE_ALONE, PULSE_WIDE, PULSE_BACK, PULSE_BACK_RMS = 2.8, 1.2, 0.45, 0.2
EDGE_ALONE, EDGE_LIKE, LEVEL_SHARE = 4.0, 0.75, 0.35
SEAM_LOW_HZ, SEAM_HIGH_HZ, SEAM_POINTS = 50, 350, 24
SEAM_ENERGY, SEAM_SIDE, SEAM_CROSS, SEAM_RATIO, SEAM_NARROW, SEAM_BEND = 0.2, 0.22, 0.75, 8.0, 0.7, 0.8


def _round(x: float) -> int:
    return math.floor(x + 0.5)


@dataclass(frozen=True)
class Reach:
    """Distances in samples at a sample rate."""

    rate: int

    @property
    def frame(self) -> int:
        return max(1, _round(self.rate * 0.01))

    @property
    def rest(self) -> int:
        return max(1, _round(self.rate * 0.004))

    @property
    def around_pulse(self) -> int:
        return max(self.rest + 3, _round(self.rate * 0.002))

    @property
    def core(self) -> int:
        return max(2, _round(self.rate * 0.0003))

    @property
    def around_edge(self) -> int:
        return max(self.core + 1, _round(self.rate * 0.00075))

    @property
    def far(self) -> int:
        return max(1, _round(self.rate * 0.03))

    @property
    def lags(self) -> range:
        least = max(2, _round(self.rate / SEAM_HIGH_HZ))
        return range(least, max(least, _round(self.rate / SEAM_LOW_HZ)) + 1, max(1, _round(self.rate / 4000)))

    @property
    def longest_lag(self) -> int:
        return max(self.lags.start, _round(self.rate / SEAM_LOW_HZ))

    @property
    def context(self) -> int:
        """Samples on either side of a chunk that decide about its own."""
        return max(2 * self.longest_lag + 1, max(self.far, self.around_edge), self.core + self.far, self.rest + self.around_pulse + 1, 2 * self.frame)


class Stretch:
    """Samples of a longer signal: x[0] is sample `first` of `total`."""

    def __init__(self, x: np.ndarray, first: int, total: int, reach: Reach):
        self.x, self.first, self.total, self.r = np.asarray(x, np.float32).astype(float), first, total, reach
        self.step = np.diff(self.x, prepend=self.x[:1])

    def frames(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Rms and linear sharpness of the frames that lie inside, each the most of three neighbours, and the first's number.

        Neighbours beyond the signal are the frame itself.
        """
        n, many = self.r.frame, self.total // self.r.frame
        a = -(-self.first // n)
        b = min(many, (self.first + len(self.x)) // n)
        x = self.x[a * n - self.first : b * n - self.first].reshape(-1, n)
        around = np.pad(x, ((0, 0), (1, 1)), mode="edge")
        bend = x - (around[:, :-2] + around[:, 2:]) / 2
        rms, sharp = np.sqrt((x**2).mean(axis=1)), np.sqrt((bend**2).mean(axis=1)) + 1e-12
        most = lambda v: np.maximum(v, np.maximum(np.append(v[:1], v[:-1]), np.append(v[1:], v[-1:])))
        return most(rms), most(sharp), a

    def candidates(self, low: int, high: int) -> np.ndarray:
        """Sample numbers within [low, high) at which a click may be counted."""
        many = self.total // self.r.frame
        if self.total < 3 or not many:
            return np.zeros(0, np.int64)
        at = np.arange(max(1, low), min(self.total - 1, high))
        rms, sharp, a = self.frames()
        frame = np.minimum(at // self.r.frame, many - 1) - a
        strength = np.abs(self.step[at - self.first])
        floor = np.maximum(LEAST_STEP, sharp[frame] * OVER_SHARP)
        large = strength >= floor
        return np.array([i for i, f, k in zip(at[large], floor[large], frame[large]) if self.pulse(i, max(f, rms[k] * OVER_RMS), rms[k]) or self.edge(i)], np.int64)

    def _peak(self, a: int, b: int) -> float:
        """The largest step to the samples a .. b of the signal, as far as they are there."""
        a, b = max(1, a) - self.first, min(self.total - 1, b) - self.first + 1
        return float(np.abs(self.step[a:b]).max(initial=0.0)) if b > a else 0.0

    def pulse(self, i: int, floor: float, rms: float) -> bool:
        at, d = i - self.first, self.step[i - self.first]
        if abs(d) < floor:
            return False
        out = self.step[at + 1 : min(self.total - 1, i + self.r.rest) - self.first + 1]
        edge = np.minimum(abs(d), np.abs(out))
        back = np.abs(self.x[at + 1 : at + 1 + len(out)] - self.x[at - 1])
        fits = (d * out < 0) & (np.abs(out) >= floor) & (back <= edge * PULSE_BACK + rms * PULSE_BACK_RMS)
        left = self._peak(i - self.r.around_pulse, i - 3) if fits.any() else 0.0
        for w in np.flatnonzero(fits) + 1:
            alone = PULSE_ALONE + w / self.r.rest * PULSE_WIDE
            if edge[w - 1] >= max(left, self._peak(i + w + 3, i + w + self.r.around_pulse)) * alone:
                return True
        return False

    def edge(self, i: int) -> bool:
        r, at, d = self.r, i - self.first, self.step[i - self.first]
        nearby = max(self._peak(i - r.around_edge, i - r.core - 1), self._peak(i + r.core + 1, i + r.around_edge))
        if abs(d) >= nearby * EDGE_ALONE or self.parts_levels(i):
            c = np.concatenate((np.arange(max(1, i - r.far), i - r.around_edge), np.arange(i + r.around_edge + 1, min(self.total - 1, i + r.far) + 1)))
            near = self.step[c - self.first]
            like = near[np.abs(near) >= abs(d) * EDGE_LIKE]
            if not (like * d > 0).any() and len(like) < 2:
                return True
        return self.narrow(at, i, d) and self.seam(i)

    def parts_levels(self, i: int) -> bool:
        r = self.r
        if i - r.core - r.far < 0 or i + r.core + r.far > self.total:
            return False
        before, after = i - r.core - r.far - self.first, i + r.core - self.first
        away = abs(self.x[after : after + r.far].mean() - self.x[before : before + r.far].mean())
        return away >= max(LEAST_STEP, abs(self.step[i - self.first]) * LEVEL_SHARE)

    def narrow(self, at: int, i: int, d: float) -> bool:
        """Whether the step is one sample wide and bends sharply on both sides."""
        if i < 2 or i + 3 >= self.total:
            return False
        wide = np.abs(self.x[at + 1 : at + 4] - self.x[at - 2 : at + 1]).max()
        bends = min(abs(d - self.step[at - 1]), abs(self.step[at + 1] - d))
        return abs(d) / max(wide, 1e-9) >= SEAM_NARROW and bends / abs(d) >= SEAM_BEND

    def seam(self, i: int) -> bool:
        lags, longest, at = self.r.lags, self.r.longest_lag, i - self.first
        if i < 2 * longest or i + 2 * longest >= self.total:
            return False
        best = None
        for lag in lags:
            k = np.arange(0, lag, max(1, lag // SEAM_POINTS))
            a, b, c, e = (self.x[at + s * lag + k] for s in (-2, -1, 0, 1))
            power = [float(v @ v) for v in (a, b, c, e)]
            sides = (power[0] + power[1]) / (2 * len(k)), (power[2] + power[3]) / (2 * len(k))
            if min(sides) / max(*sides, 1e-9) < SEAM_ENERGY:
                continue
            miss = lambda u, v, p, q: 1 - min(1.0, max(0.0, float(u @ v) / math.sqrt(max(p * q, 1e-18)))) ** 2
            left, right = miss(a, b, *power[:2]), miss(c, e, *power[2:])
            if best is None or (left + right) / 2 < best[0]:
                best = (left + right) / 2, left, right, miss(b, c, *power[1:3])
        if best is None:
            return False
        side, left, right, cross = best
        return max(left, right) <= SEAM_SIDE and cross >= SEAM_CROSS and cross / max(side, 1 / (SEAM_RATIO * 1000)) >= SEAM_RATIO


def rested(candidates, rest: int) -> list[int]:
    """Candidates in order, of which none follows a counted one within `rest` samples."""
    out: list[int] = []
    for i in candidates:
        if not out or i - out[-1] >= rest:
            out.append(int(i))
    return out


def clicks_of(samples: np.ndarray, rate: int) -> list[int]:
    """The clicks of a whole signal."""
    return rested(Stretch(samples, 0, len(samples), Reach(rate)).candidates(0, len(samples)), Reach(rate).rest)


def click_places(chunks: DataFrame, keys: list[str], rate: int, order: str = "chunk", samples: str = "samples") -> DataFrame:
    """keys, sample: the clicks of each series, from rows of its consecutive chunks (all but the last of one size).

    A series that is null, shorter than three samples or than a frame has none. Non-finite samples count as silence.
    """
    reach = Reach(rate)
    d = chunks.select(*keys, F.col(order).alias("__at"), F.transform(F.coalesce(samples, F.array().cast("array<float>")), lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v).cast("float")).alias("__x"))
    series = Window.partitionBy(*keys)
    length, before = F.size("__x").cast("long"), series.orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__first", F.coalesce(F.sum(length).over(before), F.lit(0))).withColumn("__total", F.sum(length).over(series)).withColumn("__most", F.max(length).over(series))
    most = d.agg(F.min(F.when(F.col("__most") > 0, F.col("__most")))).first()[0] or 1  # the smallest chunk size of any series
    many = -(-reach.context // int(most)) + 1  # neighbours that hold a context
    side = lambda a, b: F.flatten(F.collect_list("__x").over(series.orderBy("__at").rowsBetween(a, b)))
    left, right = side(-many, -1), side(1, many)
    left = F.slice(left, F.greatest(F.size(left) - reach.context, F.lit(0)) + 1, F.lit(reach.context))
    d = d.select(*keys, "__first", "__total", F.size("__x").alias("__own"), left.alias("__left"), "__x", F.slice(right, F.lit(1), F.lit(reach.context)).alias("__right"))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in range(len(batch)):
                b = batch.iloc[row]
                first = int(b["__first"])
                x = np.concatenate((b["__left"], b["__x"], b["__right"]))
                at = Stretch(x, first - len(b["__left"]), int(b["__total"]), reach).candidates(first, first + int(b["__own"]))
                if len(at):
                    yield batch.loc[[batch.index[row]] * len(at), keys].assign(sample=at)

    kinds = dict(chunks.dtypes)
    found = d.mapInPandas(find, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "sample long"]))
    step = lambda row, last: (True, row[0]) if last is None or row[0] - last >= reach.rest else (False, last)
    return sequential.stepwise(found, keys, ["sample"], ["sample"], "counted", "boolean", step, None).where("counted").drop("counted")


def click_counts(chunks: DataFrame, keys: list[str], rate: int, order: str = "chunk", samples: str = "samples") -> DataFrame:
    """keys, clicks: of every series, 0 included."""
    counts = click_places(chunks, keys, rate, order, samples).groupBy(*keys).agg(F.count("*").alias("clicks"))
    return chunks.select(*keys).distinct().join(counts, keys, "left").fillna(0, ["clicks"])
