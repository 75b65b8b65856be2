"""Comparison of two level envelopes of one voice, before and after processing: alignment, drift, spikes, body, runs, arcs.

Frames carry keys, frame_idx (without gaps, from 0), frame_db, peak_db and body_db; what is null or not finite is no
evidence. One alignment is found, and all measures are taken on frames renumbered by it, with the source's speech as the
only guide to what counts. A series is compared with the one of equal keys; keys must not be null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions import scalar as sc
from cadenza.functions.percentiles import linear
from cadenza.operators import blocks, joins, runs
from cadenza.sources.tables import kept

C = F.col
#: Milliseconds, decibels, counts and shares of the comparison.
SECTION_MS, SECTION_LAG, SHOULDER_MS, CORE_MS, LEAST_SHOULDER_MS, NEAR_MS, SEARCH_MS = 10_000, 6, 400, 60, 80, 20, 250
BETTER_DB, SPIKE_DB, EXPRESSIVE_DB, CREST_DB, FLAT_SHARE, FLAT_DB = 0.05, 1.5, 2.5, 6.0, 0.55, 2.0
LEAST_FRAMES, SUPPORT_DB, WINDOW_MS, HOP_MS, SUPPORTED, QUIET_DB, LEAST_WINDOWS, WORSE_DB, EDGE_SHARE = 20, 24.0, 300, 100, 0.8, 18.0, 5, 0.5, 0.2
EXPRESSIVE_GAP_MS, SPIKE_GAP_MS, MOST_EVENTS = 80, 100, 5
#: Of a block's sorted values every so many-th bounds the ranks of the rest.
STEP = 128
LEVELS = ("frame_db", "peak_db", "body_db")


def _known(x: str) -> Column:
    return F.when(sc.is_finite(C(x)), C(x))


@dataclass(frozen=True)
class Grid:
    """Milliseconds in frames of a length."""

    frame_ms: float

    def frames(self, ms: float, least: int = 1) -> int:
        return max(least, math.floor(ms / self.frame_ms + 0.5))


def support(frames: DataFrame, keys: list[str], body: str = "body_db") -> DataFrame:
    """frames (with speech) and support: speech whose body is no more than 24 dB under its median; all speech where
    fewer than 20 frames have a body."""
    w = Window.partitionBy(*keys)
    spoken = F.when(C("speech"), C(body))
    d = frames.withColumn("__middle", F.median(spoken).over(w)).withColumn("__many", F.count(spoken).over(w))
    near = C("speech") & F.coalesce(C(body) >= C("__middle") - SUPPORT_DB, F.lit(False))
    return d.withColumn("support", F.when(C("__many") >= LEAST_FRAMES, near).otherwise(C("speech"))).drop("__middle", "__many")


def _paired_blocks(source: DataFrame, candidate: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, a, b: of each block of frames the source's levels with support and the candidate's, at equal places, with
    `most` frames of the candidate beside the block; NaN where there is none."""
    at = (C("frame_idx") - C("__block") * blocks.SIZE + most).cast("int").alias("__at")
    none, level = F.lit(None).cast("double"), C("frame_db").cast("double")
    heard = source.where("support").withColumn("__block", F.floor(C("frame_idx") / blocks.SIZE)).select(*keys, "__block", at, level.alias("a"), none.alias("b"))
    other = blocks.beside_blocks(candidate, most).select(*keys, "__block", at, none.alias("a"), level.alias("b"))
    both = heard.unionByName(other)
    schema = T.StructType([*(both.schema[k] for k in keys), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in "ab")])

    def of_block(table: pa.Table) -> pa.Table:
        where, out = table["__at"].to_numpy(), {k: table[k].slice(0, 1) for k in keys}
        for c in "ab":
            x = table[c].to_numpy()
            known, levels = ~np.isnan(x), np.full(int(where.max()) + 1, np.nan)
            levels[where[known]] = x[known]
            out[c] = pa.array([levels], pa.list_(pa.float64()))
        return pa.table(out)

    return both.groupBy(*keys, "__block").applyInArrow(of_block, schema)


def _of_lags(paired: DataFrame, keys: list[str], most: int, work: Callable[..., dict[str, np.ndarray]], made: list[str], facts: DataFrame | None = None) -> DataFrame:
    """keys, lag and the columns `made`: what `work` gives for a block's sorted differences at each lag, or for their
    distances from `middle`, if the facts (keys, lag, and columns that work gets too) have it."""
    given = facts is not None
    if given:
        named = [c for c in facts.columns if c not in keys]
        paired = paired.join(facts.groupBy(*keys).agg(F.collect_list(F.struct(*named)).alias("__facts")), keys)
    fields = [T.StructField("lag", T.LongType()), *(T.StructField(c, T.DoubleType() if c == "x" else T.LongType()) for c in made)]

    def differences(a: np.ndarray, b: np.ndarray, lag: int) -> np.ndarray:
        at = np.flatnonzero(~np.isnan(a))
        at = at[at + lag < len(b)]  # the first place is `most`
        d = b[at + lag] - a[at]
        return d[~np.isnan(d)]

    def of_batch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in "ab")
                known = {f["lag"]: f for f in batch.column("__facts")[i].as_py()} if given else dict.fromkeys(range(-most, most + 1), {})
                parts = []
                for lag, fact in known.items():
                    d = differences(a, b, lag)
                    if len(d):
                        found = work(np.sort(np.abs(d - fact["middle"]) if "middle" in fact else d), fact)
                        parts.append({"lag": np.full(len(found["x"]), lag), **found})
                if parts:
                    cols = {c: np.concatenate([p[c] for p in parts]) for c in ("lag", *made)}
                    same = pa.array(np.full(len(cols["lag"]), i))
                    yield pa.RecordBatch.from_pydict({k: batch.column(k).take(same) for k in keys} | {c: pa.array(v, pa.float64() if c == "x" else pa.int64()) for c, v in cols.items()})

    schema = T.StructType([*(paired.schema[k] for k in keys), *fields])
    return paired.mapInArrow(of_batch, schema)


def _steps(x: np.ndarray, _fact: dict) -> dict[str, np.ndarray]:
    """Every STEP-th of sorted values and the last, with how many there are from the one before and up to the next."""
    at = np.unique(np.append(np.arange(0, len(x), STEP), len(x) - 1))
    return {"x": x[at], "since": np.diff(at, prepend=-1), "until": np.diff(at, append=len(x))}


def _between(x: np.ndarray, fact: dict) -> dict[str, np.ndarray]:
    """The values of the bracket with their counts, after one entry for those under it."""
    first, last = np.searchsorted(x, fact["low"], "left"), np.searchsorted(x, fact["high"], "right")
    values, counts = np.unique(x[first:last], return_counts=True)
    return {"x": np.append(-np.inf, values), "many": np.append(first, counts)}


def _medians(paired: DataFrame, keys: list[str], most: int, facts: DataFrame | None = None) -> DataFrame:
    """keys, lag, pairs, median of all differences at a lag, or of their distances from the facts' middle.

    Steps through each block's sorted values bound every rank: the median lies between two of them with few values between,
    and only those are sorted together.
    """
    by = Window.partitionBy(*keys, "lag").orderBy("x")
    middle = (C("pairs") - 1) / 2
    steps = _of_lags(paired, keys, most, _steps, ["x", "since", "until"], facts)
    steps = steps.groupBy(*keys, "lag", "x").agg(F.sum("since").alias("since"), F.sum("until").alias("until"))
    steps = steps.withColumn("pairs", F.sum("since").over(Window.partitionBy(*keys, "lag")))
    under = F.coalesce(F.sum("until").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # at most so many are less
    upto = F.sum("since").over(by.rowsBetween(Window.unboundedPreceding, 0))  # at least so many are not more
    steps = steps.withColumns({"under": under, "upto": upto})
    low, high = F.max(F.when(C("under") <= F.floor(middle), C("x"))), F.min(F.when(C("upto") > F.ceil(middle), C("x")))
    bracket = steps.groupBy(*keys, "lag").agg(F.first("pairs").alias("pairs"), low.alias("low"), high.alias("high"))
    bracket = kept(bracket if facts is None else bracket.join(facts.select(*keys, "lag", "middle"), [*keys, "lag"]), "brackets")
    inside = _of_lags(paired, keys, most, _between, ["x", "many"], bracket).groupBy(*keys, "lag", "x").agg(F.sum("many").alias("many"))
    inside = inside.withColumn("upto", F.sum("many").over(by.rowsBetween(Window.unboundedPreceding, 0))).join(bracket.select(*keys, "lag", "pairs"), [*keys, "lag"])
    holds = lambda rank: F.max(F.when((rank >= C("upto") - C("many")) & (rank < C("upto")), C("x")))
    found = inside.groupBy(*keys, "lag").agg(F.first("pairs").alias("pairs"), holds(F.floor(middle)).alias("__a"), holds(F.ceil(middle)).alias("__b"))
    return kept(found.select(*keys, "lag", "pairs", (C("__a") * 0.5 + C("__b") * 0.5).alias("median")), "medians")


def alignment(source: DataFrame, candidate: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """keys, lag, improvement: how many frames later the candidate is, and what the error fell by against no lag.

    The error is the median distance of the levels' differences from their median, over all source frames with support (at
    least 20 of them). A lag replaces the best before it if it is 0.05 dB better, or as good and nearer to none. Without a
    score at no lag the lag is 0 and the improvement null.
    """
    most = int(SEARCH_MS // frame_ms)
    paired = kept(_paired_blocks(source, candidate, keys, most), "paired")
    middles = _medians(paired, keys, most).withColumnRenamed("median", "middle")
    spread = _medians(paired, keys, most, middles.select(*keys, "lag", "middle")).withColumnRenamed("median", "score")
    listed = spread.where(C("pairs") >= LEAST_FRAMES).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("lag", "score"))).alias("__all"))  # a lag each
    zero = F.filter("__all", lambda s: s["lag"] == 0)[0]
    better = lambda b, s: (s["score"] < b["score"] - BETTER_DB) | ((F.abs(s["score"] - b["score"]) <= 1e-9) & (F.abs(s["lag"]) < F.abs(b["lag"])))
    best = F.when(zero.isNotNull(), F.aggregate(F.filter("__all", lambda s: s["lag"] != 0), zero, lambda b, s: F.when(better(b, s), s).otherwise(b)))
    found = listed.select(*keys, best.alias("__best"), zero["score"].alias("__zero"))
    every = source.select(*keys).distinct().join(candidate.select(*keys).distinct(), keys).join(found, keys, "left")
    return every.select(*keys, F.coalesce("__best.lag", F.lit(0)).cast("long").alias("lag"), F.when(C("__zero").isNotNull(), F.greatest(F.lit(0.0), C("__zero") - C("__best.score"))).alias("improvement"))


def aligned(source: DataFrame, candidate: DataFrame, keys: list[str], frame_ms: float, mask: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(frames, lags): paired frames (keys, offset, frame_idx from 0, s_ and c_ levels, speech, support), and `alignment`.

    mask gives frames (keys, frame_idx, frame_db) a column `active`: the source's speech, before and after aligning.
    """
    clean = lambda d: d.select(*keys, C("frame_idx").cast("long").alias("frame_idx"), *(_known(c).alias(c) for c in LEVELS))
    a, b = clean(source), clean(candidate)

    def spoken(d: DataFrame, db: str) -> DataFrame:
        heard = mask(d.select(*keys, "frame_idx", F.coalesce(db, F.lit(-120.0)).alias("frame_db"))).select(*keys, "frame_idx", C("active").alias("speech"))
        return d.join(heard, [*keys, "frame_idx"])

    lags = alignment(support(spoken(a, "frame_db"), keys), b, keys, frame_ms)
    left = a.select(*keys, "frame_idx", *(C(c).alias(f"s_{c[:-3]}") for c in LEVELS)).join(lags.select(*keys, "lag"), keys)
    right = b.select(*keys, C("frame_idx").alias("__at"), *(C(c).alias(f"c_{c[:-3]}") for c in LEVELS))
    both = left.withColumn("__at", C("frame_idx") + C("lag")).join(right, [*keys, "__at"]).withColumn("offset", F.greatest(F.lit(0), -C("lag")))
    both = both.withColumn("frame_idx", C("frame_idx") - C("offset")).drop("__at", "lag")
    return support(spoken(both, "s_frame"), keys, "s_body"), lags


def contrasts(frames: DataFrame, keys: list[str], frame_ms: float, domain: str) -> DataFrame:
    """keys, offset, frame_idx, s_contrast, c_contrast, s_crest, c_crest of supported frames between two shoulders of
    supported ones; domain: frame or body (which has no crests)."""
    g = Grid(frame_ms)
    far, core, least = g.frames(SHOULDER_MS, 5), g.frames(CORE_MS), g.frames(LEAST_SHOULDER_MS, 2)
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    left, right = w.rowsBetween(-far, -core - 1), w.rowsBetween(core + 1, far)
    d, cols = frames, {}
    enough = C("support") & (C("frame_idx") >= far) & (C("frame_idx") + far < F.count("*").over(Window.partitionBy(*keys)))
    for side in "sc":
        x = C(f"{side}_{domain}")
        heard = F.when(C("support"), x)
        enough = enough & x.isNotNull() & (F.count(heard).over(left) >= least) & (F.count(heard).over(right) >= least)
        cols[f"{side}_contrast"] = x - (F.avg(heard).over(left) + F.avg(heard).over(right)) / 2
        cols[f"{side}_crest"] = C(f"{side}_peak") - x if domain == "frame" else F.lit(None).cast("double")
    return d.select(*keys, "offset", "frame_idx", *(v.alias(k) for k, v in cols.items()), F.coalesce(enough, F.lit(False)).alias("__ok")).where("__ok").drop("__ok")


def _near(keys: list[str], frame_ms: float):
    reach = Grid(frame_ms).frames(NEAR_MS)
    return Window.partitionBy(*keys).orderBy("frame_idx").rangeBetween(-reach, reach)


def _time(frame: Column, frame_ms: float) -> Column:
    return F.round((C("offset") + frame) * frame_ms / 1000, 6)


def spike_events(found: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """keys, direction, start_sec, end_sec, center_sec, peak: stretches where processing adds 1.5 dB or more of contrast
    to what the source has within a frame or so; the first of equal peaks is the centre."""
    up = F.greatest(F.lit(0.0), C("c_contrast") - F.max("s_contrast").over(_near(keys, frame_ms)))
    down = F.greatest(F.lit(0.0), F.min("s_contrast").over(_near(keys, frame_ms)) - C("c_contrast"))
    each = found.withColumns({"__up": up, "__down": down})
    both = F.array(*(F.struct(F.lit(k).alias("direction"), C(f"__{k}").alias("added")) for k in ("up", "down")))
    each = each.select(*keys, "offset", "frame_idx", F.explode(both).alias("__s"))
    each = each.select(*keys, "offset", "frame_idx", "__s.*").where(C("added") >= SPIKE_DB)
    peak = F.max(F.struct("added", (-C("frame_idx")).alias("minus")))
    d = runs.gap_clusters(each, [*keys, "direction"], "frame_idx", Grid(frame_ms).frames(SPIKE_GAP_MS), F.first("offset").alias("offset"), peak.alias("__p"))
    times = (_time(C("first"), frame_ms).alias("start_sec"), _time(C("last") + 1, frame_ms).alias("end_sec"), _time(0.5 - C("__p.minus"), frame_ms).alias("center_sec"))
    return d.select(*keys, "direction", *times, C("__p.added").alias("peak"))


def top_events(events: DataFrame, keys: list[str], value: str) -> DataFrame:
    return runs.top_per_group(events, keys, [F.desc(value), C("start_sec")], MOST_EVENTS)


def expressive(found: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """found (contrasts of frames) with event: the number of the expressive event that a frame belongs to, or null.

    Expressive are contrasts among the source's top tenth, and half as strong ones with crests among the top tenth.
    """
    w = Window.partitionBy(*keys)
    contrast = F.greatest(F.lit(EXPRESSIVE_DB), F.percentile(F.when(C("s_contrast") > 0, C("s_contrast")), F.lit(0.9)).over(w))
    crest = F.greatest(F.lit(CREST_DB), F.percentile("s_crest", F.lit(0.9)).over(w))
    loud = (C("s_contrast") >= contrast) | F.coalesce((C("s_contrast") >= EXPRESSIVE_DB / 2) & (C("s_crest") >= crest), F.lit(False))
    d = found.withColumn("__loud", loud).where("__loud").select(*keys, "frame_idx")
    new = F.when(C("frame_idx") - F.lag("frame_idx").over(w.orderBy("frame_idx")) <= Grid(frame_ms).frames(EXPRESSIVE_GAP_MS), 0).otherwise(1)
    d = d.withColumn("__new", new).select(*keys, "frame_idx", F.sum("__new").over(w.orderBy("frame_idx")).alias("event"))
    return found.join(d, [*keys, "frame_idx"], "left")


def retention_events(loud: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """Of each expressive event: its times, the source's strongest contrast, the candidate's strongest near it, ratio,
    delta, crest_delta and flattened. Events without a positive source contrast are left out."""
    near = _near(keys, frame_ms)
    d = loud.withColumn("__best", F.max(F.struct("c_contrast", (-C("frame_idx")).alias("minus"), "c_crest")).over(near)).where("event is not null")
    top = F.max(F.struct("s_contrast", (-C("frame_idx")).alias("minus"), "s_crest", "__best"))
    e = d.groupBy(*keys, "event").agg(F.first("offset").alias("offset"), F.min("frame_idx").alias("__a"), F.max("frame_idx").alias("__b"), top.alias("t")).where("t.s_contrast > 0")
    ratio, delta = F.greatest(F.lit(0.0), C("t.__best.c_contrast")) / C("t.s_contrast"), C("t.__best.c_contrast") - C("t.s_contrast")
    return e.select(
        *keys, "event", _time(C("__a"), frame_ms).alias("start_sec"), _time(C("__b") + 1, frame_ms).alias("end_sec"), _time(0.5 - C("t.minus"), frame_ms).alias("center_sec"),
        C("t.s_contrast").alias("s_contrast"), C("t.__best.c_contrast").alias("c_contrast"), ratio.alias("ratio"), delta.alias("delta"),
        (C("t.__best.c_crest") - C("t.s_crest")).alias("crest_delta"), ((ratio < FLAT_SHARE) | (delta <= -FLAT_DB)).alias("flattened"),
    )


def body(frames: DataFrame, loud: DataFrame, keys: list[str]) -> DataFrame:
    """keys, body_frames, and of source and candidate the floor (p10) and spread (p90 - p10) around the median, their
    differences, and how the balance of body to whole level moved; nulls under 20 frames. Expressive frames do not count."""
    d = frames.join(loud.where("event is not null").select(*keys, "frame_idx"), [*keys, "frame_idx"], "left_anti")
    known = C("support") & C("s_body").isNotNull() & C("c_body").isNotNull() & C("s_frame").isNotNull() & C("c_frame").isNotNull()
    stats = [F.count("*").alias("n")]
    for s in "sc":
        x = C(f"{s}_body")
        stats += [(linear(x, 0.1) - F.median(x)).alias(f"{s}_floor"), (linear(x, 0.9) - linear(x, 0.1)).alias(f"{s}_spread"), F.median(x - C(f"{s}_frame")).alias(f"{s}_balance")]
    d = frames.select(*keys).distinct().join(d.where(known).groupBy(*keys).agg(*stats), keys, "left")
    shown = lambda x: F.when(C("n") >= LEAST_FRAMES, x)
    return d.select(
        *keys, F.coalesce("n", F.lit(0)).alias("body_frames"), *(shown(C(c)).alias(c) for c in ("s_floor", "c_floor", "s_spread", "c_spread")),
        shown(C("c_floor") - C("s_floor")).alias("floor_fill"), shown(C("c_spread") - C("s_spread")).alias("spread_delta"), shown(C("c_balance") - C("s_balance")).alias("balance_delta"),
    )


def _run_windows(frames: DataFrame, keys: list[str], frame_ms: float, flag: str) -> DataFrame:
    """keys, run_id, window, s, c, n, loud: medians of supported bodies in sliding windows that lie inside runs of a flag."""
    g = Grid(frame_ms)
    size, hop = g.frames(WINDOW_MS), g.frames(HOP_MS)
    d = runs.with_run_id(frames, keys, flag).where(flag)
    run = Window.partitionBy(*keys, "run_id")
    d = d.withColumn("__a", C("frame_idx") - F.min("frame_idx").over(run)).withColumn("__len", F.count("*").over(run))
    first, last = F.greatest(F.lit(0), F.ceil((C("__a") - size + 1) / hop)), F.least(F.floor(C("__a") / hop), F.floor((C("__len") - size) / hop))
    d = d.where((C("__len") >= size) & (first <= last)).withColumn("window", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    known = C("support") & C("s_body").isNotNull() & C("c_body").isNotNull()
    return d.groupBy(*keys, "run_id", "window").agg(
        F.median(F.when(known, C("s_body"))).alias("s"), F.median(F.when(known, C("c_body"))).alias("c"), F.count_if(known).alias("n"), F.max(F.coalesce(C("event"), F.lit(0))).alias("loud")
    ).where(C("n") >= math.ceil(size * SUPPORTED))


def _with_events(frames: DataFrame, loud: DataFrame, keys: list[str]) -> DataFrame:
    return frames.join(loud.select(*keys, "frame_idx", "event"), [*keys, "frame_idx"], "left")


def _middle(frames: DataFrame, keys: list[str]) -> DataFrame:
    heard = F.when(C("support"), C("s_body"))
    return frames.groupBy(*keys).agg(F.median(heard).alias("__middle"), F.count(heard).alias("__heard")).where(C("__heard") >= LEAST_FRAMES)


def run_spreads(frames: DataFrame, loud: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """keys, run_id, s_spread, c_spread of runs of speech with at least five windows that are neither expressive nor
    18 dB under the body's median."""
    w = _run_windows(_with_events(frames, loud, keys), keys, frame_ms, "speech").join(_middle(frames, keys), keys)
    w = w.where((C("loud") == 0) & (C("s") >= C("__middle") - QUIET_DB))
    spread = lambda x: linear(C(x), 0.9) - linear(C(x), 0.1)
    return w.groupBy(*keys, "run_id").agg(F.count("*").alias("windows"), spread("s").alias("s_spread"), spread("c").alias("c_spread")).where(C("windows") >= LEAST_WINDOWS)


def run_arcs(frames: DataFrame, loud: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """keys, run_id, and of both sides spread, rise to and fall from the loudest inner window, of runs of supported body."""
    d = _with_events(frames, loud, keys).join(_middle(frames, keys).select(*keys, "__middle"), keys)
    held = C("speech") & C("support") & C("c_body").isNotNull() & F.coalesce(C("s_body") >= C("__middle") - SUPPORT_DB, F.lit(False))
    w = _run_windows(d.withColumn("__held", held), keys, frame_ms, "__held")
    run = Window.partitionBy(*keys, "run_id")
    w = w.withColumn("__i", F.row_number().over(run.orderBy("window"))).withColumn("__n", F.count("*").over(run))
    edge = F.greatest(F.lit(1), sc.half_up(C("__n") * EDGE_SHARE))
    w = w.withColumn("__e", edge).where((C("__n") >= LEAST_WINDOWS) & (C("__n") > 2 * C("__e")))
    out = []
    for s in "sc":
        peak = F.max(F.when((C("__i") > C("__e")) & (C("__i") <= C("__n") - C("__e")), C(s)))
        out += [
            (linear(C(s), 0.9) - linear(C(s), 0.1)).alias(f"{s}_spread"), (peak - F.median(F.when(C("__i") <= C("__e"), C(s)))).alias(f"{s}_rise"),
            (peak - F.median(F.when(C("__i") > C("__n") - C("__e"), C(s)))).alias(f"{s}_fall"),
        ]
    return w.groupBy(*keys, "run_id").agg(*out)


def sections(frames: DataFrame, keys: list[str], frame_ms: float) -> DataFrame:
    """keys, nth, mid_sec, s_level, c_level, delta of sections of ten seconds with five frames of speech or more."""
    size = Grid(frame_ms).frames(SECTION_MS)
    whole = F.count("*").over(Window.partitionBy(*keys))
    d = frames.withColumn("__n", whole).where(C("speech") & C("s_frame").isNotNull() & C("c_frame").isNotNull()).withColumn("section", F.floor(C("frame_idx") / size))
    d = d.groupBy(*keys, "section").agg(F.median("s_frame").alias("s_level"), F.median("c_frame").alias("c_level"), F.median(C("c_frame") - C("s_frame")).alias("delta"), F.count("*").alias("frames"), F.first("__n").alias("__n"))
    mid = (C("section") * size + F.least("__n", C("section") * size + size)) * frame_ms / 2000
    d = d.where("frames >= 5").withColumn("mid_sec", mid)
    return d.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("section")).cast("long").alias("nth"), "section", "mid_sec", "s_level", "c_level", "delta", "frames")


def drift(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slopes in decibels a minute (medians of source, candidate and their difference; its rising and falling
    quarters), and the spread of differences over sections."""
    levels = ("s_level", "c_level", "delta")
    many = F.count("*").over(Window.partitionBy(*keys))
    d = found.withColumn("__many", many)
    later = d.select(*keys, "nth", C("mid_sec").alias("__t"), *(C(c).alias(f"__{c}") for c in levels))
    pairs = joins.lagged_pairs(d, later, keys, range(1, SECTION_LAG + 1), "nth").where((C("lag") >= 2) | (C("__many") < 3))
    minutes = (C("__t") - C("mid_sec")) / 60
    pairs = pairs.select(*keys, *(((C(f"__{c}") - C(c)) / minutes).alias(c) for c in levels))
    slopes = pairs.groupBy(*keys).agg(
        F.median("s_level").alias("s_slope"), F.median("c_level").alias("c_slope"), F.median("delta").alias("slope"),
        F.greatest(F.lit(0.0), linear(C("delta"), 0.75)).alias("rising"), F.least(F.lit(0.0), linear(C("delta"), 0.25)).alias("falling"),
    )
    spread = found.groupBy(*keys).agg((linear(C("delta"), 0.9) - linear(C("delta"), 0.1)).alias("section_spread"), F.count("*").alias("sections"))
    return spread.join(slopes, keys, "left")
