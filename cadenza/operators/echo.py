"""What is left of an echo: its tap at a known delay, the delayed blend that takes it out, and gains that close on tails.

Samples are rows of consecutive frames of one size; a frame is given the samples a delay before it, so tasks work alone
and only sums meet. Tails are windows over frames; the gain that follows its target faster down than up hands its last
value from batch to batch.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc
from cadenza.operators import blocks, sequential

C = F.col
#: The tap's range, the least current sample, mix and stride; of tails the least run before them, where they
#: start and are full (frames), depth, floor, and the shares of the way that the gain goes down and up in a frame.
TAP_LOW, TAP_HIGH, QUIET, MIX, STRIDE, LEAST_TAP = -0.36, 0.12, 2e-5, 0.65, 8, 0.03
STRICT = {"least_run": 5, "start": 1, "full": 5, "depth": 0.985, "floor": 0.015, "attack": 0.99, "release": 0.68}
FINISH = {"least_run": 6, "start": 12, "full": 20, "depth": 0.9, "floor": 0.1, "attack": 0.3, "release": 0.16}
BODY_DROP, TAIL_DROP, AHEAD_MS = 8.0, 10.0, 260


def _delayed(frames: DataFrame, keys: list[str], size: int, delay: int, samples: str) -> DataFrame:
    """frames with __first (number of their first sample) and __back: the samples `delay` before, 0 before the signal.

    The last frame may be shorter.
    """
    many = -(-delay // size)
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-many, -1)
    before = F.flatten(F.collect_list(samples).over(w))
    lead = F.concat(F.array_repeat(F.lit(0.0), many * size), F.transform(before, lambda v: v.cast("double")))
    whole = F.concat(F.slice(lead, F.size(lead) - delay + 1, F.lit(delay)), F.transform(samples, lambda v: v.cast("double")))
    return frames.withColumn("__first", C("frame_idx") * size).withColumn("__back", F.slice(whole, F.lit(1), F.size(samples)))


def residual_tap(frames: DataFrame, keys: list[str], size: int, delay: int, samples: str = "samples", stride: int = STRIDE) -> DataFrame:
    """keys, tap: the share of the signal a delay before that is in the signal, by every `stride`-th sample that is not silent."""
    d = _delayed(frames, keys, size, delay, samples)
    first = C("__first")
    pairs = F.zip_with(F.transform(samples, lambda v, i: F.struct(v.cast("double").alias("x"), (first + i).alias("at"))), C("__back"), lambda a, b: F.struct(a["x"].alias("x"), a["at"].alias("at"), b.alias("b")))
    used = F.filter(pairs, lambda p: (p["at"] >= delay) & ((p["at"] - delay) % stride == 0) & (F.abs(p["x"]) >= QUIET))
    total = lambda f: F.aggregate(used, F.lit(0.0), lambda s, p: s + f(p))
    d = d.select(*keys, total(lambda p: p["x"] * p["b"]).alias("__n"), total(lambda p: p["b"] * p["b"]).alias("__d"))
    return d.groupBy(*keys).agg(sc.clamp(F.sum("__n") / (F.sum("__d") + 1e-9), TAP_LOW, TAP_HIGH).alias("tap"))


def delay_blend(frames: DataFrame, taps: DataFrame, keys: list[str], size: int, delay: int, samples: str = "samples", mix: float = MIX) -> DataFrame:
    """frames with the echo taken out of their samples, within -1..1; a tap under 0.03 changes nothing."""
    d = _delayed(frames, keys, size, delay, samples).join(taps.select(*keys, C("tap").alias("__tap")), keys, "left")
    first, tap = C("__first"), C("__tap")
    own = F.transform(samples, lambda v, i: F.struct(v.cast("double").alias("x"), (first + i).alias("at")))
    cut = F.zip_with(own, C("__back"), lambda a, b: F.when(a["at"] >= delay, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a["x"] - mix * tap * b))).otherwise(a["x"]))
    plain = F.transform(samples, lambda v: v.cast("double"))
    return d.withColumn(samples, F.when(F.abs(tap) >= LEAST_TAP, cut).otherwise(plain)).drop("__first", "__back", "__tap")


def _since(frames: DataFrame, keys: list[str], run: str | None = None) -> DataFrame:
    """frames (with speech) with __since (frames since speech; null before any) and __run (frames of the last run of it)."""
    d = blocks.with_run_id(frames, keys, "speech", out="__id") if run is None else frames.withColumn("__id", C(run))
    sizes = d.groupBy(*keys, "__id").agg(F.count("*").alias("__size"), F.min("frame_idx").alias("__first"))
    d = sc.with_facts(d, sizes, [*keys, "__id"]).withColumn("__in", C("frame_idx") - C("__first") + 1)
    d = blocks.last_known(d, keys, {"__last": F.when(C("speech"), C("frame_idx")), "__run": F.when(C("speech"), C("__size"))})
    return d.withColumn("__since", C("frame_idx") - C("__last")).drop("__id", "__size", "__first", "__last")


def _closing(n: Column, depth: float, floor: float, start: int, full: int) -> Column:
    return F.greatest(F.lit(floor), 1 - depth * sc.unit(n / max(1, full - start)))


def strict_targets(frames: DataFrame, keys: list[str], o: dict = STRICT, run: str | None = None) -> DataFrame:
    """frames (with speech) with target: after a run of speech the gain closes within a few frames."""
    d = _since(frames, keys, run)
    tail = ~C("speech") & (C("__run") >= o["least_run"]) & (C("__since") >= o["start"])
    closing = _closing(C("__since") - o["start"], o["depth"], o["floor"], o["start"], o["full"])
    return d.withColumn("target", F.when(tail, closing).otherwise(1.0)).drop("__since", "__run", "__in")


def finishing_targets(frames: DataFrame, keys: list[str], frame_ms: float, db: str = "db", o: dict = FINISH, run: str | None = None) -> DataFrame:
    """frames (with speech and a level) with target: the gain closes slowly after speech, and on speech that decays away
    from its body (the series' p85) with no strong frame to come within 260 ms."""
    ahead = max(o["full"], math.floor(AHEAD_MS / frame_ms + 0.5))
    next_ones = Window.partitionBy(*keys, "__block").orderBy("frame_idx").rowsBetween(1, ahead - 1)
    d = sc.with_facts(_since(frames, keys, run), pct.placed(frames, keys, {"__body": (db, 0.85)}).drop("__n"), keys)
    strong = C(db) >= C("__body") - BODY_DROP
    d = blocks.last_known(d, keys, {"__last": F.when(C("speech") & strong, C("frame_idx"))})
    d = blocks.beside_blocks(d, ahead)
    coming = F.coalesce(F.max(strong.cast("int")).over(next_ones), F.lit(0)) > 0
    away = F.coalesce(C("frame_idx") - C("__last"), C("frame_idx") + 10_000)  # a series starts far from any body
    d = blocks.of_blocks(d.withColumn("__away", away).withColumn("__coming", coming)).drop("__last")
    closing = lambda n: _closing(n - o["start"], o["depth"], o["floor"], o["start"], o["full"])
    decays = C("speech") & ~strong & (C("__in") >= o["least_run"]) & (C("__away") >= o["start"]) & (C(db) <= C("__body") - TAIL_DROP) & ~C("__coming")
    tail = ~C("speech") & (C("__run") >= o["least_run"]) & (C("__since") >= o["start"])
    target = F.when(decays, closing(C("__away"))).when(tail, closing(C("__since"))).otherwise(1.0)
    return d.withColumn("target", target).drop("__since", "__run", "__in", "__body", "__away", "__coming")


def asymmetric(frames: DataFrame, keys: list[str], target: str, attack: float, release: float, out: str = "gain", start: float = 1.0) -> DataFrame:
    """frames with a curve that goes a share of the way to its target each frame: `attack` downward, `release` upward.

    What a gain was fades by the slower of the two shares each frame: a block that starts as many frames earlier as leave
    1e-17 of it gives the same gains, so long series are dealt by blocks.
    """

    def step(row: tuple, last: float) -> tuple:
        now = last + (row[0] - last) * (attack if row[0] < last else release)
        return now, now

    slowest = 1 - min(attack, release)
    if slowest >= 1:  # a gain that stays where it is has no end to its memory
        return sequential.stepwise(frames, keys, ["frame_idx"], [target], out, "double", step, start)
    d = blocks.beside_blocks(frames, math.ceil(math.log(1e-17) / math.log(slowest)) if slowest > 0 else 1)
    return blocks.of_blocks(sequential.stepwise(d, [*keys, "__block"], ["frame_idx"], [target], out, "double", step, start))


def apply_gains(frames: DataFrame, keys: list[str], samples: str = "samples", gain: str = "gain") -> DataFrame:
    """frames with samples times a gain that goes evenly from the frame before's to their own."""
    before = F.coalesce(F.lag(gain).over(Window.partitionBy(*keys).orderBy("frame_idx")), C(gain))
    d = frames.withColumn("__before", before)
    many, a, b = F.size(samples), C("__before"), C(gain)
    return d.withColumn(samples, F.transform(samples, lambda v, i: v.cast("double") * (a * (1 - i / many) + b * (i / many)))).drop("__before")
