"""Ordered-frame functions, each a window expression over (keys, frame_idx). One sort per series serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _around(keys: list[str], order: str, a: int, b: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(a, b)


def onward(keys: list[str], order: str = "frame_idx") -> WindowSpec:
    """From a frame to the end of its series, as a prefix of the reversed order: Spark adds a frame to a prefix, but works
    out one that ends with the series anew for each row."""
    return Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)


def moving_mean(x: str, keys: list[str], radius: int, order: str = "frame_idx") -> Column:
    """Centred mean, cut at the edges."""
    return F.avg(x).over(_around(keys, order, -radius, radius))


def neighbour_mean(x: str, keys: list[str], radius: int, order: str = "frame_idx") -> Column:
    """Centred mean without the frame itself; the frame's own value if it has no neighbour."""
    w = _around(keys, order, -radius, radius)
    return F.when(F.count(x).over(w) > 1, (F.sum(x).over(w) - F.col(x)) / (F.count(x).over(w) - 1)).otherwise(F.col(x))


def shoulder_contrast(x: str, keys: list[str], near: int, far: int, least: int, order: str = "frame_idx") -> Column:
    """x less the mean of its left and right shoulder means; null unless both shoulders have `least` frames."""
    left, right = _around(keys, order, -far, -near), _around(keys, order, near, far)
    enough = (F.count(x).over(left) >= least) & (F.count(x).over(right) >= least)
    return F.when(enough, F.col(x) - (F.avg(x).over(left) + F.avg(x).over(right)) / 2)


def active_distance(active: Column, keys: list[str], order: str = "frame_idx") -> Column:
    """Frames to the nearest active one; null in a series without any."""
    here = F.when(active, F.col(order))
    back = F.last(here, ignorenulls=True).over(_around(keys, order, Window.unboundedPreceding, 0))
    ahead = F.last(here, ignorenulls=True).over(onward(keys, order))
    return F.least(F.col(order) - back, ahead - F.col(order))


def slew_majorant(x: str, keys: list[str], step: float, order: str = "frame_idx") -> Column:
    """The least curve over x that falls by at most `step` a frame in either direction, without a loop.

    f[i] = max(x[i], f[i-1] - step) is max over j <= i of (x[j] + step j) - step i; the other way round likewise.
    """
    i = F.col(order)
    forward = F.max(F.col(x) + step * i).over(_around(keys, order, Window.unboundedPreceding, 0)) - step * i
    backward = F.max(F.col(x) - step * i).over(onward(keys, order)) + step * i
    return F.greatest(forward, backward)


def slew_minorant(x: str, keys: list[str], step: float, order: str = "frame_idx") -> Column:
    """The greatest curve under x that rises by at most `step` a frame in either direction."""
    i = F.col(order)
    forward = F.min(F.col(x) - step * i).over(_around(keys, order, Window.unboundedPreceding, 0)) + step * i
    backward = F.min(F.col(x) + step * i).over(onward(keys, order)) - step * i
    return F.least(forward, backward)


def trailing_percentile(x: str, keys: list[str], frames: int, p: float, order: str = "frame_idx") -> Column:
    """Exact percentile of the frames before this one."""
    return F.percentile(x, F.lit(p)).over(_around(keys, order, -frames, -1))


def protection_halo(x: str, keys: list[str], reach: int, order: str = "frame_idx") -> Column:
    """max over neighbours j within reach of x[j] (1 - |j - i| / (reach + 1))."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = [(F.lag(x, d) if d > 0 else F.lead(x, -d)).over(w) * (1 - abs(d) / (reach + 1)) if d else F.col(x) for d in range(-reach, reach + 1)]
    return F.greatest(*near)


def tumbling(df: DataFrame, keys: list[str], frames: int, order: str = "frame_idx") -> DataFrame:
    return df.withColumn("section", F.floor(F.col(order) / frames).cast("long"))


def sliding(df: DataFrame, keys: list[str], frames: int, hop: int, order: str = "frame_idx") -> DataFrame:
    """Each frame once for every window [k hop, k hop + frames) that holds it; `frames / hop` rows at most."""
    first = F.greatest(F.lit(0), F.ceil((F.col(order) - frames + 1) / hop))
    return df.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col(order) / hop).cast("long"))))
