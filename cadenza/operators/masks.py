"""Activity masks by hysteresis. The state machine is sequential; its state is handed over the sorted batches of a series."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import is_finite
from cadenza.operators.runs import finalize_mask
from cadenza.operators.sequential import over_sorted, schema_with


@dataclass(frozen=True)
class Hysteresis:
    """Frame counts and lifts over the noise floor; the defaults are those of 10 ms frames."""

    open_lift: float = 11.5
    close_lift: float = 8.5
    hold: int = 14
    soft_hold: int = 18
    soft_margin: float = 14.0
    confirm: int = 4
    least_run: int = 6
    bridge: int = 9
    open_range: tuple[float, float] = (-58.0, -24.0)
    close_range: tuple[float, float] = (-60.0, -26.0)


def smoothed(db: np.ndarray) -> np.ndarray:
    """Centred mean of three, cut at the edges."""
    if not len(db):
        return db
    sums = np.concatenate(([0.0], np.cumsum(db)))
    at = np.arange(len(db))
    low, high = np.maximum(at - 1, 0), np.minimum(at + 2, len(db))
    return (sums[high] - sums[low]) / (high - low)


class Gate:
    """Open on a confirmed level, stay while the hold lasts; the further below closing, the faster it runs out."""

    def __init__(self, floor: float, h: Hysteresis = Hysteresis()):
        self.h, self.soft = h, floor + h.soft_margin
        self.opens, self.closes = (float(np.clip(floor + lift, *span)) for lift, span in ((h.open_lift, h.open_range), (h.close_lift, h.close_range)))
        self.active, self.hold, self.soft_used = False, 0, False

    @property
    def ahead(self) -> int:
        """Frames after one that decide about it."""
        return self.h.confirm + 2

    def confirmed(self, level: np.ndarray) -> np.ndarray:
        loud = np.concatenate(([0], np.cumsum(level >= self.closes)))
        reach = np.minimum(np.arange(len(level)) + self.ahead, len(level))
        return (level >= self.opens) & (loud[reach] - loud[: len(level)] >= self.h.confirm)

    def step(self, x: float, raw: float, confirmed: bool) -> bool:
        h = self.h
        if not self.active:
            if confirmed:
                self.active, self.hold = True, h.hold
            return self.active
        if x >= self.opens:
            self.hold, self.soft_used = h.hold, False
        elif x >= self.closes:
            self.hold, self.soft_used = max(self.hold, int(np.ceil(h.hold * 0.45))), False
        elif x >= self.soft and raw >= self.soft:
            if not self.soft_used:
                self.hold, self.soft_used = max(self.hold, h.soft_hold), True
            self.hold -= 1
        else:
            self.soft_used = False
            self.hold -= 3 if self.closes - x >= 8 else 2 if self.closes - x >= 4 else 1
        if self.hold < 0:
            self.active, self.hold, self.soft_used = False, 0, False
        return self.active

    def steps(self, db: np.ndarray, a: int, b: int) -> np.ndarray:
        """The next frames a to b of db, which also has what lies around them."""
        level = smoothed(db)
        sure = self.confirmed(level)
        return np.array([self.step(*x) for x in zip(level[a:b], db[a:b], sure[a:b])], bool)


def hysteresis(db: np.ndarray, floor: float, h: Hysteresis = Hysteresis()) -> np.ndarray:
    return Gate(floor, h).steps(db, 0, len(db))


class _Opened:
    """Frames wait until those that decide about them are there; one frame before them stays for the smoothing."""

    def __init__(self, db: str, h: Hysteresis):
        self.db, self.h, self.gate, self.before, self.rows = db, h, None, 0, None

    def _emit(self, rest: int) -> pd.DataFrame | None:
        ready = len(self.rows) - self.before - rest
        if ready <= 0:
            return None
        level = self.rows[self.db].to_numpy(float)
        mask = self.gate.steps(np.where(np.isfinite(level), level, -120.0), self.before, self.before + ready)
        out = self.rows.iloc[self.before : self.before + ready].drop(columns="__floor").assign(active=mask)
        self.rows, self.before = self.rows.iloc[self.before + ready - 1 :], 1
        return out

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        if self.gate is None:
            self.gate, self.rows = Gate(float(rows["__floor"].iloc[0]), self.h), rows
        else:
            self.rows = pd.concat([self.rows, rows])
        return self._emit(self.gate.ahead)

    def end(self) -> pd.DataFrame | None:
        return self._emit(0)


def activity_mask(frames: DataFrame, key: str, db: str = "db", floor_percent: float = 0.25, h: Hysteresis = Hysteresis(), order: str = "frame_idx") -> DataFrame:
    """key, order, db, active: the noise floor is a percentile of the series; then short runs go and gaps close.

    Levels that are null or not finite count as -120 dB and not for the floor.
    """
    slim = frames.select(key, order, db)
    floor = F.percentile(F.when(is_finite(F.col(db)), F.col(db)), F.lit(floor_percent))
    d = slim.withColumn("__floor", F.coalesce(floor.over(Window.partitionBy(key)), F.lit(-120.0)))
    masked = over_sorted(d, [key], [order], lambda: _Opened(db, h), schema_with(slim, "active boolean"))
    return finalize_mask(masked, [key], "active", h.least_run, h.bridge, order)


def percentile_mask(frames: DataFrame, key: str, value: str, percent: float, lift: float) -> DataFrame:
    """The stateless variant: active where the value is at least the series' percentile plus a lift."""
    floor = frames.groupBy(key).agg(F.percentile(value, F.lit(percent)).alias("noise_floor"))
    return frames.join(floor, key).withColumn("active", F.col(value) >= F.col("noise_floor") + lift)
