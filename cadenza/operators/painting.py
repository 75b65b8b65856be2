"""Corrections of a planned gain curve within runs of speech: short valleys, events that need no lift, extreme trends.

Frames are rows in order, `body` marks those of speech. Every correction is a set of windows over a run; only the samples
of a run's trend, twenty at most, are regrouped. A missing or non-finite level or gain is no evidence: it leaves the gain
of its frame as it was, and a slice or a shoulder that holds one counts as missing. Runs of one frame, and series without
speech, keep their gains. Curves are doubles throughout.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc
from cadenza.operators import blocks, runs
from cadenza.operators.windows import onward
from cadenza.sources.tables import kept

C = F.col
#: Shoulders of a valley (ms) and how much of it is filled; context of an event (ms), how much of it counts,
#: knee, the gain at which half is at stake, headroom; window of a trend (ms), most lift, usual fade and its softness,
#: shares that may be recovered, knee; shoulders and centre of a valley that recurs (ms), share filled, most lift, knee,
#: evidence from and in full, frames a unit of it, steepest slope of a lift by frame; window of a word (ms), percentile it
#: is held against, share recovered, most lift, knee, where a low stretch is too long to be words (ms), shoulder and core of
#: a crest (ms), contrast a lift may add, and how much more where levels are unstable.
INNER_MS, OUTER_MS, FILL = 60, 140, 0.7
CONTEXT_MS, LENDING, EVENT_KNEE, AUTHORITY_DB, HEADROOM_DB = 240, 0.25, 0.35, 6.0, 0.5
TREND_MS, MOST_LIFT, USUAL_FADE, SOFTNESS, LEAST_SHARE, MOST_SHARE, TREND_KNEE = 100, 3.2, 9.0, 4.0, 0.12, 0.28, 0.18
LEAST_SAMPLES, MOST_SAMPLES = 4, 20
WIDE_INNER_MS, WIDE_OUTER_MS, CENTRE_MS, WIDE_FILL, WIDE_LIFT, WIDE_KNEE, FROM_DB, FULL_DB, RARITY, SLOPE = 90, 240, 40, 0.6, 4.0, 0.5, 0.75, 6.0, 0.04, 0.24
WORD_MS, WORD_RANK, WORD_SHARE, WORD_LIFT, WORD_KNEE, LONG_MS, LONGEST_MS, SHOULDER_MS, CORE_MS, CONTRAST, MORE_CONTRAST = 300, 0.7, 0.62, 3.6, 0.6, 1000, 1800, 400, 60, 1.18, 0.22


def _steps(ms: float, frame_ms: float, least: int) -> int:
    return max(least, math.floor(ms / frame_ms + 0.5))


def _finite(x: Column) -> Column:
    return F.when(sc.is_finite(x), x.cast("double"))


def _numbered(frames: DataFrame, keys: list[str], body: str, run: str | None) -> DataFrame:
    """frames with __run; `run` is a column that numbers the runs already, so that nothing is put in order by series."""
    return runs.with_run_id(frames, keys, body, out="__run") if run is None else frames.withColumn("__run", C(run))


def relax_valleys(frames: DataFrame, keys: list[str], source: str, gain: str, body: str, frame_ms: float = 10.0, out: str = "gain", run: str | None = None) -> DataFrame:
    """frames with `out`: the gain, lifted where it digs a short valley into speech.

    A valley is measured from the lower of two shoulders, 60 to 140 ms away on both sides; what the source has of it
    itself stays. Frames whose shoulders do not lie in their run whole stay.
    """
    inner = _steps(INNER_MS, frame_ms, 1)
    outer = _steps(OUTER_MS, frame_ms, inner)
    w = Window.partitionBy(*keys, "__run").orderBy("frame_idx")
    sides = w.rowsBetween(-outer, -inner), w.rowsBetween(inner, outer)
    level, plan = _finite(C(source)), _finite(C(gain))
    d = _numbered(frames, keys, body, run)
    d = d.withColumn("__s", F.when(plan.isNotNull(), level)).withColumn("__o", level + plan)
    whole = lambda c, side: F.when(F.count(c).over(side) == outer - inner + 1, F.avg(c).over(side))
    for k, side in enumerate(sides):
        d = d.withColumn(f"__s{k}", whole("__s", side)).withColumn(f"__o{k}", whole("__o", side))
    dug = F.least("__o0", "__o1") - C("__o")
    added = dug - (F.least("__s0", "__s1") - C("__s"))
    lift = sc.all_present(F.greatest(F.lit(0.0), F.least(dug, added)), *(C(f"__{c}{k}") for c in "so" for k in (0, 1)), C("__o"))
    lifted = F.when(C(body) & (lift > 0), C(gain) + lift * FILL).otherwise(C(gain))
    return d.withColumn(out, lifted).drop("__run", "__s", "__o", *(f"__{c}{k}" for c in "so" for k in (0, 1)))


def event_level(frames: DataFrame, by: list[str], source: str, frame_ms: float) -> Column:
    """The level around a frame of a run: power under a raised cosine, as three plain sums over a window.

    cos^2 of half an angle is (1 + cos) / 2, and the cosine of a difference parts into a frame's own and the others'.
    """
    reach = _steps(CONTEXT_MS / 2, frame_ms, 2)
    w = Window.partitionBy(*by).orderBy("frame_idx").rowsBetween(-reach, reach)
    angle = F.pmod(C("frame_idx"), F.lit(2 * (reach + 1))) * (math.pi / (reach + 1))
    power = F.pow(F.lit(10.0), _finite(C(source)) / 10)

    def weighted(x: Column) -> Column:
        parts = F.sum(x).over(w), F.sum(x * F.cos(angle)).over(w), F.sum(x * F.sin(angle)).over(w)
        return (parts[0] + F.cos(angle) * parts[1] + F.sin(angle) * parts[2]) / 2

    return 10 * F.log10(F.greatest(F.lit(0.0), weighted(power) / weighted(F.when(power.isNotNull(), 1.0))) + 1e-30)


def limit_authority(frames: DataFrame, keys: list[str], source: str, gain: str, body: str, target_db: float | Column, frame_ms: float = 10.0, out: str = "gain", run: str | None = None) -> DataFrame:
    """frames with `out`: lifts in speech cut to what an event still lacks of the target level.

    A loud event within a quiet run keeps its own level; nothing falls below it, and cuts stay as they are.
    """
    d = _numbered(frames, keys, body, run)
    d = d.withColumn("__around", event_level(d, [*keys, "__run"], source, frame_ms))
    level, plan = _finite(C(source)), _finite(C(gain))
    here = level + (C("__around") - level) * LENDING
    target = target_db if isinstance(target_db, Column) else F.lit(target_db)
    up = F.greatest(F.lit(0.0), plan)
    excess = sc.soft_plus(up - sc.soft_plus(target + HEADROOM_DB - here, EVENT_KNEE), EVENT_KNEE)
    authority = F.pow(up, 4) / (F.pow(up, 4) + AUTHORITY_DB**4)
    cut = F.least(F.lit(0.0), plan) + F.greatest(F.lit(0.0), up - excess * authority)
    known = C(body) & here.isNotNull() & plan.isNotNull() & target.isNotNull()
    return d.withColumn(out, F.when(known, cut).otherwise(C(gain))).drop("__run", "__around")


def _slice_db(inside: Column, level: Column) -> Column:
    """Aggregate: power mean of the levels inside; null if one of them is missing."""
    missing = F.max(F.when(inside, level.isNull().cast("int"))) > 0
    return F.when(~missing, 10 * F.log10(F.avg(F.when(inside, F.pow(F.lit(10.0), level / 10))) + 1e-30))


def run_trends(frames: DataFrame, by: list[str], level: str, gain: str, frame_ms: float = 10.0) -> DataFrame:
    """Per run (`by`; frames with __at from 0 and the run's length __n): what lift its trend still wants.

    by, rising, lift (at the run's full end; null where the trend wants none). The trend goes from the tenth to the nine
    tenths of a run; it counts as far as samples along the run move the same way, in both halves of it.
    """
    at, n, x, g = C("__at"), C("__n"), _finite(C(level)), _finite(C(gain))
    window = F.greatest(F.lit(1), F.least(F.lit(_steps(TREND_MS, frame_ms, 1)), F.floor(n / 4)))
    half = F.greatest(F.lit(1), F.floor(window / 2))
    many = F.greatest(F.lit(LEAST_SAMPLES), F.least(F.lit(MOST_SAMPLES), F.floor(n / window))).cast("int")
    near = lambda centre: F.abs(at - centre) <= half
    head, tail = sc.half_up(n * 0.1), sc.half_up(n * 0.9)
    centre = lambda k: sc.half_up(k / (many - 1) * (n - 1))
    used = frames.where(n >= 2)
    ends = used.groupBy(*by).agg(
        F.max(n).alias("__n"), F.max(head).alias("__hc"), F.max(tail).alias("__tc"),
        _slice_db(near(head), x).alias("__head"), _slice_db(near(tail), x).alias("__tail"),
        F.coalesce(F.avg(F.when(near(head), g)), F.lit(0.0)).alias("__hg"), F.coalesce(F.avg(F.when(near(tail), g)), F.lit(0.0)).alias("__tg"),
    )
    touched = F.filter(F.sequence(F.lit(0), many - 1), lambda k: near(centre(k)))
    samples = used.select(*by, x.alias("__x"), many.alias("__many"), F.explode(touched).alias("__k"))
    samples = samples.groupBy(*by, "__k", "__many").agg(_slice_db(F.lit(True), C("__x")).alias("__db")).where("__db IS NOT NULL")
    step = C("__db") - F.lag("__db").over(Window.partitionBy(*by).orderBy("__k"))
    early = (C("__k") - 0.5) / (C("__many") - 1) <= 0.5
    total = lambda v: F.coalesce(F.sum(v), F.lit(0.0))
    up, down = F.greatest(F.lit(0.0), C("__step")), F.greatest(F.lit(0.0), -C("__step"))
    travel = samples.withColumn("__step", F.coalesce(step, F.lit(0.0))).groupBy(*by).agg(
        total(F.when(early, up)).alias("__ue"), total(F.when(~early, up)).alias("__ul"), total(F.when(early, down)).alias("__de"), total(F.when(~early, down)).alias("__dl"),
    )
    d = ends.where("__head IS NOT NULL AND __tail IS NOT NULL").join(travel, by)
    rising = C("__tail") > C("__head")
    trend = F.greatest(F.lit(0.0), sc.soft_plus(F.abs(C("__tail") - C("__head")), TREND_KNEE) - TREND_KNEE * math.log(2))
    first, last = F.when(rising, C("__ue")).otherwise(C("__de")), F.when(rising, C("__ul")).otherwise(C("__dl"))
    every = C("__ue") + C("__ul") + C("__de") + C("__dl")
    spent = (first + last) / (every + TREND_KNEE) * sc.unit(2 * F.least(first, last) / (first + last + TREND_KNEE))
    share = (LEAST_SHARE + (MOST_SHARE - LEAST_SHARE) * (0.5 + 0.5 * F.tanh((trend - USUAL_FADE) / SOFTNESS))) * spent
    now = F.when(rising, C("__hg") - C("__tg")).otherwise(C("__tg") - C("__hg"))
    wanted = F.least(F.lit(MOST_LIFT), sc.soft_plus(F.least(trend * share, trend * MOST_SHARE) - now, TREND_KNEE) * spent)
    along = F.greatest(F.lit(1), C("__n") - 1)
    apart = F.greatest(F.lit(0.1), sc.smooth_ramp(C("__tc") / along, 0, 1) - sc.smooth_ramp(C("__hc") / along, 0, 1))
    return d.select(*by, rising.alias("rising"), F.when((trend > 0) & (wanted > 0), F.least(F.lit(MOST_LIFT), wanted / apart)).alias("lift"))


def balance_trends(frames: DataFrame, keys: list[str], level: str, gain: str, body: str, floor: str, most_gain: float, frame_ms: float = 10.0, out: str = "gain", run: str | None = None) -> DataFrame:
    """frames with `out`: a smooth lift of the weak end of runs whose level rises or falls far and steadily.

    The lift fades near the noise floor and ends at `most_gain`; it never lowers a gain within that.
    """
    by = [*keys, "__run"]
    part = Window.partitionBy(*by)
    d = _numbered(frames, keys, body, run)
    d = d.withColumn("__n", F.count("*").over(part)).withColumn("__at", C("frame_idx") - F.min("frame_idx").over(part))
    d = d.join(run_trends(d.where(C(body)), by, level, gain, frame_ms).withColumnsRenamed({"rising": "__rising", "lift": "__lift"}), by, "left")
    ramp = sc.smooth_ramp(C("__at") / F.greatest(F.lit(1), C("__n") - 1), 0, 1)
    above = 1 / (1 + F.exp(-(_finite(C(level)) - (C(floor) + 8)) / 4))
    lift = C("__lift") * F.when(C("__rising"), 1 - ramp).otherwise(ramp) * above
    lifted = F.when(C(body) & lift.isNotNull() & sc.is_finite(C(gain)), F.least(F.lit(most_gain), C(gain) + F.greatest(F.lit(0.0), lift))).otherwise(C(gain))
    return d.withColumn(out, lifted).drop("__run", "__n", "__at", "__rising", "__lift").select(*frames.columns, *([out] if out not in frames.columns else []))


def spread_lifts(lift: Column, by: list[str], slope: float = SLOPE) -> Column:
    """The least curve over `lift` that moves by at most `slope` a frame: a line falls to both sides of each frame."""
    w = Window.partitionBy(*by).orderBy("frame_idx")
    up = F.max(lift + C("frame_idx") * slope).over(w.rowsBetween(Window.unboundedPreceding, 0)) - C("frame_idx") * slope
    down = F.max(lift - C("frame_idx") * slope).over(onward(by)) + C("frame_idx") * slope
    return F.greatest(up, down)


def recover_valleys(frames: DataFrame, keys: list[str], source: str, level: str, gain: str, body: str, most_gain: float, frame_ms: float = 10.0, out: str = "gain", run: str | None = None) -> DataFrame:
    """frames with `out`: lifts of short valleys that source and body level share and that recur within a run.

    A lift grows with the run's evidence by length and leans on slopes of 0.24 dB a frame. A series with a level or gain
    that is missing or not finite keeps its gains, as do runs of 48 frames of 10 ms and fewer.
    """
    inner = _steps(WIDE_INNER_MS, frame_ms, 1)
    outer = _steps(WIDE_OUTER_MS, frame_ms, inner + 1)
    centre = _steps(CENTRE_MS / 2, frame_ms, 1)
    by = [*keys, "__run"]
    part = Window.partitionBy(*by)
    w = part.orderBy("frame_idx")
    bad = F.max((_finite(C(source)).isNull() | _finite(C(level)).isNull() | _finite(C(gain)).isNull()).cast("int"))
    d = sc.with_facts(_numbered(frames, keys, body, run), kept(frames.groupBy(*keys).agg(bad.alias("__bad")), "missing"), keys)

    def dug(x: Column) -> Column:
        sides = F.avg(x).over(w.rowsBetween(-outer, -inner - 1)), F.avg(x).over(w.rowsBetween(inner + 1, outer))
        return F.least(*sides) - F.avg(x).over(w.rowsBetween(-centre, centre))

    inside = C(body) & (F.row_number().over(w) > outer) & (F.lead(F.lit(1), outer).over(w) == 1) & (C("__bad") == 0)
    d = d.withColumn("__dug", F.when(inside, F.least(dug(_finite(C(source))), dug(_finite(C(level))))))
    d = d.withColumn("__dug", F.coalesce(F.greatest(F.lit(0.0), sc.soft_plus(C("__dug"), WIDE_KNEE) - WIDE_KNEE * math.log(2)), F.lit(0.0)))
    evidence = F.sum(F.coalesce(sc.smooth_ramp(C("__dug"), FROM_DB, FULL_DB), F.lit(0.0))).over(part)
    d = d.withColumn("__lift", F.least(F.lit(WIDE_LIFT), C("__dug") * WIDE_FILL) * evidence / (evidence + F.count("*").over(part) * RARITY))
    long = C(body) & (C("__bad") == 0) & (F.count("*").over(part) > 2 * outer)
    lifted = F.when(long, F.least(F.lit(most_gain), C(gain) + spread_lifts(C("__lift"), by))).otherwise(C(gain))
    return d.withColumn(out, lifted).drop("__run", "__bad", "__dug", "__lift")


def hold_slopes(lift: Column, by: list[str], slope: float = SLOPE, at: Column | None = None, n: Column | None = None) -> Column:
    """The largest curve under `lift` that moves by at most `slope` a frame and is 0 just outside its run.

    A frame's place in its run (from 1) and the run's length are given where `by` is a part of a run.
    """
    w = Window.partitionBy(*by).orderBy("frame_idx")
    if at is None:
        at, n = F.row_number().over(w), F.count("*").over(Window.partitionBy(*by))
    up = F.min(lift - C("frame_idx") * slope).over(w.rowsBetween(Window.unboundedPreceding, 0)) + C("frame_idx") * slope
    down = F.min(lift + C("frame_idx") * slope).over(onward(by)) - C("frame_idx") * slope
    return F.least(up, down, at * slope, (n - at + 1) * slope)


def flatten_crests(frames: DataFrame, by: list[str], lift: str, instability: float | Column = 0.5, frame_ms: float = 10.0, at: Column | None = None, n: Column | None = None) -> DataFrame:
    """frames with `lift` lowered, twice, to what lies around it plus a small contrast; runs (`by`) of two shoulders stay.

    `at` and `n` as in hold_slopes.
    """
    shoulder, core = _steps(SHOULDER_MS, frame_ms, 5), _steps(CORE_MS, frame_ms, 1)
    if core >= shoulder:
        return frames
    w = Window.partitionBy(*by).orderBy("frame_idx")
    sides = w.rowsBetween(-shoulder, -core - 1), w.rowsBetween(core + 1, shoulder)
    hint = instability if isinstance(instability, Column) else F.lit(instability)
    most = CONTRAST + MORE_CONTRAST * sc.unit(hint)
    many = F.count("*").over(Window.partitionBy(*by)) if n is None else n
    inner = (F.row_number().over(w) > shoulder) & (F.lead(F.lit(1), shoulder).over(w) == 1) if at is None else (at > shoulder) & (at + shoulder <= n)
    d = frames
    for _ in range(2):
        around = (F.avg(lift).over(sides[0]) + F.avg(lift).over(sides[1])) / 2
        d = d.withColumn("__flat", F.when(inner, F.least(C(lift), around + most)).otherwise(C(lift)))
        d = d.withColumn(lift, F.when(many > 2 * shoulder, hold_slopes(C("__flat"), by, at=at, n=n)).otherwise(C(lift)))
    return d.drop("__flat")


def _ramp(x: np.ndarray, start: float, full: float) -> np.ndarray:
    t = np.clip((x - start) / (full - start), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def _power_mean(half: int):
    """Work of blocks.worked_out: levels around a frame, as the mean of their power over `half` frames on both sides."""

    def mean(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        around = lambda v: np.lib.stride_tricks.sliding_window_view(np.pad(v, half), 2 * half + 1).sum(axis=1)
        many = around(known.astype(np.float64))
        with np.errstate(all="ignore"):
            level = 10 * np.log10(around(np.where(known, np.power(10.0, x / 10), 0.0)) / many + 1e-30)
        return np.where(many > 0, level, np.nan)

    return lambda read: {"__s": mean(read["__raw"]), "__b": mean(read["__own"]), "__o": mean(read["__own"] + read["__plan"])}


def _stretches(frame_ms: float):
    """Work of blocks.worked_out: each frame's lift by what its low stretch is worth. The last frame of a stretch's part in
    a block has its sum, and whether it begins (1) or ends (2) at the block's edge, where it may go on."""

    def work(read: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        on, home = read["__on"] > 0, read["home"]
        n = len(on)
        starts = np.concatenate(([0], np.flatnonzero(on[1:] != on[:-1]) + 1))
        ends = np.append(starts[1:], n)
        ms = (ends - starts) * frame_ms
        worth = np.where(on[starts], _ramp(ms, 0, WORD_MS) ** 4 * (1 - 0.75 * _ramp(ms, LONG_MS, LONGEST_MS)), 0.0)
        lift = read["__all"] * np.repeat(worth, ends - starts)
        total, edge = np.full(n, np.nan), np.zeros(n, np.int32)
        at = np.flatnonzero(home)
        if len(at):
            first, last = at[0], at[-1]
            inside = on[starts] & (ends > first) & (starts <= last)
            a, b = np.maximum(starts[inside], first), np.minimum(ends[inside], last + 1)
            so_far = np.array([lift[x:y].sum() for x, y in zip(a, b)])
            total[b - 1] = so_far
            edge[b - 1] = (a == first) + 2 * (b == last + 1)
        return {"__lift": lift, "__sum": total, "__edge": edge}

    return work


def _recurring(d: DataFrame, by: list[str]) -> DataFrame:
    """by, __again: how far the lifts are shared out among stretches, 0 if all is in one. Stretches that go over blocks are
    put together from one row a block."""
    open_at = lambda *edges: F.max(F.when(C("__edge").isin(*edges), C("__sum")))
    d = d.groupBy(*by, "__block").agg(F.sum("__sum").alias("__total"), open_at(0).alias("__inner"), open_at(1, 3).alias("__head"), open_at(2).alias("__tail"), open_at(3).alias("__through"))
    goes_on = F.lag(C("__through").isNotNull() | C("__tail").isNotNull()).over(Window.partitionBy(*by).orderBy("__block"))
    pieces = F.array(F.struct(F.lit(0).alias("at"), "__head", (~F.coalesce(goes_on, F.lit(False))).alias("new")), F.struct(F.lit(1).alias("at"), C("__tail").alias("__head"), F.lit(True).alias("new")))
    p = d.withColumn("__p", pieces).select(*by, "__block", "__total", "__inner", F.explode("__p").alias("__p")).select(*by, "__block", "__total", "__inner", "__p.at", "__p.new", C("__p.__head").alias("__sum"))
    w = Window.partitionBy(*by).orderBy("__block", "at").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("__chain", F.sum((C("new") & C("__sum").isNotNull()).cast("int")).over(w))
    p = p.groupBy(*by, "__chain").agg(F.sum("__sum").alias("__sum"), F.max("__inner").alias("__inner"), F.sum(F.when(C("at") == 0, C("__total"))).alias("__total"))
    total, most = F.sum("__total"), F.greatest(F.max("__sum"), F.max("__inner"))
    return p.groupBy(*by).agg(F.when(total > 0, sc.smooth_ramp(1 - most / total, 0, 0.5)).otherwise(0.0).alias("__again"))


def _settled(most: float, frame_ms: float):
    """Work of blocks.worked_out: `__lift` spread by slopes and without crests, as spread_lifts and flatten_crests have it."""
    shoulder, core = _steps(SHOULDER_MS, frame_ms, 5), _steps(CORE_MS, frame_ms, 1)

    def held(x: np.ndarray, slope: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        up = np.minimum.accumulate(x - slope) + slope
        down = np.minimum.accumulate((x + slope)[::-1])[::-1] - slope
        return np.minimum(np.minimum(up, down), np.minimum(at, n - at + 1) * SLOPE)

    def work(read: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x, at, n = read["__lift"], read["frame_idx"] - read["__start"] + 1, read["__n"]
        slope = read["frame_idx"] * SLOPE
        x = np.maximum(np.maximum.accumulate(x + slope) - slope, np.maximum.accumulate((x - slope)[::-1])[::-1] + slope)
        k = np.arange(len(x))
        inner = (at > shoulder) & (at + shoulder <= n)
        sides = [(np.clip(k + a, 0, len(x)), np.clip(k + b, 0, len(x))) for a, b in ((-shoulder, -core), (core + 1, shoulder + 1))]
        for _ in range(2 if core < shoulder else 0):
            so_far = np.concatenate(([0.0], np.cumsum(x)))
            with np.errstate(all="ignore"):
                around = sum((so_far[b] - so_far[a]) / (b - a) for a, b in sides) / 2
            flat = np.where(inner, np.fmin(x, around + most), x)
            x = np.where(n > 2 * shoulder, held(flat, slope, at, n), x)
        return {"__settled": x}

    return work


def stabilize_words(frames: DataFrame, keys: list[str], source: str, level: str, gain: str, body: str, floor: str, most_gain: float, instability: float = 0.5, frame_ms: float = 10.0, out: str = "gain", run: str | None = None) -> DataFrame:
    """frames with `out`: lifts of words that are low against their run's usual level, if several are.

    Source and body level must agree on what is low, and what the gain lifts already counts. One low stretch alone, however
    deep, gets nothing; a stretch counts most at the length of words. Runs shorter than 300 ms keep their gains, and so do
    runs with a level or gain that is missing or not finite.
    """
    size = _steps(WORD_MS, frame_ms, 1)
    half = max(1, size // 2)
    by = [*keys, "__run"]
    over = lambda v: F.greatest(F.lit(0.0), F.when(v > 0, sc.soft_plus(v, WORD_KNEE) - WORD_KNEE * math.log(2)))
    raw, own, plan = _finite(C(source)), _finite(C(level)), _finite(C(gain))
    d = _numbered(frames, keys, body, run).withColumns({"__raw": raw, "__own": own, "__plan": plan})
    levels = dict.fromkeys(("__s", "__b", "__o"), "double")
    d = kept(blocks.worked_out(d, keys, "__run", half, _power_mean(half), ["__raw", "__own", "__plan"], levels).drop("__block"), "words")
    bad = F.max((C("__raw").isNull() | C("__own").isNull() | C("__plan").isNull()).cast("int")).alias("__bad")
    wanted = {f"__p{c}": (f"__{c}", WORD_RANK) for c in ("s", "b", "o", "raw", "own")} | {"__p10": ("__b", 0.1), "__p90": ("__b", 0.9)}
    d = sc.with_facts(d, pct.placed(d, by, wanted, nearest=True, also=(F.min("frame_idx").alias("__start"), bad)), by)
    # what is named several times gets a column of its own: expressions stay short
    d = d.withColumns({f"__v{c}": C(f"__p{c}") - C(f"__{c}") for c in "sbo"})
    d = d.withColumns({"__low": F.least(over(C("__vs")), over(C("__vb"))), "__od": over(C("__vo"))})
    d = d.withColumn("__lacking", F.least(F.lit(WORD_LIFT), C("__low") * WORD_SHARE) - (C("__low") - C("__od")))
    voiced = 1 - 0.6 * sc.smooth_ramp(C("__s") - C("__b"), 6, 12)
    above = 1 / (1 + F.exp(-(C("__b") - (C(floor) + 8)) / 4))
    d = d.withColumn("__lift", F.when(C("__low") > 0, F.least(F.lit(WORD_LIFT), over(C("__lacking"))) * above * voiced).otherwise(0.0))
    d = d.withColumn("__on", F.coalesce((C("__praw") > C("__raw")) & (C("__pown") > C("__own")), F.lit(False)).cast("int"))
    spread = F.greatest(F.lit(0.0), C("__p90") - C("__p10"))
    moved = (0.68 + 0.29 * min(1.0, max(0.0, instability))) / (1 + F.exp(-(spread - 5) / 2)) * (1 - 0.12 * sc.smooth_ramp(spread, 12, 20))
    d = d.withColumns({"__moved": F.coalesce(moved, F.lit(0.0)), "__all": F.coalesce("__lift", F.lit(0.0))})
    d = d.select(*frames.columns, "__run", "__start", "__n", "__bad", "__moved", "__on", "__all")
    # a stretch of the greatest length that tells is worth the same as any longer one
    longest = math.ceil(LONGEST_MS / frame_ms) + 1
    worth = blocks.worked_out(d, keys, "__run", longest, _stretches(frame_ms), ["__all", "__on"], {"__lift": "double", "__sum": "double", "__edge": "int"})
    d = kept(worth.drop("__all", "__on"), "stretches")
    d = sc.with_facts(d.drop("__block", "__sum", "__edge"), kept(_recurring(d, by), "recurrence"), by)
    d = d.withColumn("__lift", C("__lift") * C("__again") * C("__moved"))
    # lifts lie within 0 and WORD_LIFT, so a slope ends within so many frames, and a crest looks one shoulder further
    reach = 3 * (math.ceil(WORD_LIFT / SLOPE) + 1) + 2 * _steps(SHOULDER_MS, frame_ms, 5)
    contrast = CONTRAST + MORE_CONTRAST * min(1.0, max(0.0, instability))
    d = blocks.worked_out(d, keys, "__run", reach, _settled(contrast, frame_ms), ["__lift", "frame_idx", "__start", "__n"], {"__settled": "double"})
    good = C(body) & (C("__bad") == 0) & (C("__n") >= size)
    fixed = F.when(good, F.least(F.lit(most_gain), C(gain) + C("__settled"))).otherwise(C(gain))
    return d.withColumn(out, fixed).select(*frames.columns, *([out] if out not in frames.columns else []))


def keep_edges(frames: DataFrame, keys: list[str], established: str, candidate: str, body: str, out: str = "gain") -> DataFrame:
    """frames with `out`: the candidate gain in speech, lowered until no step is steeper than that of the established
    curve or 0.24 dB, whichever is more. Frames whose run misses a gain keep the candidate.

    A curve below given steps is a window identity: with the steps added up, it is the least of what the frames before and
    after allow.
    """
    by = [*keys, "__run"]
    w = Window.partitionBy(*by).orderBy("frame_idx")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), onward(by)
    old, new = _finite(C(established)), _finite(C(candidate))
    d = runs.with_run_id(frames, keys, body, out="__run").withColumn("__bad", F.max((old.isNull() | new.isNull()).cast("int")).over(Window.partitionBy(*by)))
    step = F.when(F.row_number().over(w) > 1, F.greatest(F.lit(SLOPE), F.abs(old - F.lag(old).over(w)))).otherwise(0.0)
    d = d.withColumn("__step", step).withColumn("__sum", F.sum("__step").over(back))
    d = d.withColumn("__up", F.min(new - C("__sum")).over(back) + C("__sum"))
    held = F.min(C("__up") + C("__sum")).over(ahead) - C("__sum")
    return d.withColumn(out, F.when(C(body) & (C("__bad") == 0), F.least(held, C(candidate))).otherwise(C(candidate))).drop("__run", "__bad", "__step", "__sum", "__up")
