"""Metrics of a quality report from a series' speech runs, and the findings that follow from them.

Frames carry keys, frame_idx, a level and an activity flag. All metrics come from one pass that knows each frame's place
in its run; a series without the evidence that a metric needs has 0 there, never a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.percentiles import linear
from cadenza.functions.scalar import power_mean_db, unit, with_facts
from cadenza.operators import runs as rn

#: Least frames of a run in which levels may swing; strong steps between its parts; decibels and
#: milliseconds of the opening and of the ends of runs.
SWING_FRAMES, STRONG_DB = 80, 0.65
HEAD_MS, HEAD_RUNS, DIP_WARN_DB, DIP_FLAG_DB, DIP_FLOOR_DB, DIP_SPAN_DB = 2500, 3, 1.5, 2.5, 1.0, 4.0
TAIL_MS, BODY_MS = 150, 450
#: Metric, limit, finding, advice, in the order of the report. The opening dip has two limits.
FINDINGS = (
    ("pause", 0.45, "Noise uplift risk in pauses.", "Use stricter pause-noise protection and verify long silences after leveling."),
    ("instability", 0.5, "Large voice-level jumps detected.", "Use instability-safe leveling with less downstream gain-riding."),
    ("swing", 0.38, "In-line high-low-high swing detected.", "Bias the leveler toward stronger line continuity on this take."),
    ("jump", 0.34, "Sentence-to-sentence level mismatch detected.", "Prefer continuity-safe single-pass leveling when grouped lines do not sit evenly."),
    ("cold_open", DIP_FLAG_DB, "cold_open_dip: first speech runs sit below the later dialogue body.", "Lift and recheck the first few spoken words against the later body level."),
    ("cold_open", DIP_WARN_DB, "Cold-open level dip warning.", "Verify that the opening words do not tuck under the later dialogue body."),
    ("onset", 0.38, "First-word/onset spike risk detected.", "Use onset spike taming before auto-leveling on line starts."),
    ("breath", 0.34, "Breath or inhale spikes are standing above line level.", "Apply breath-spike taming ahead of the leveler so inhales are not promoted."),
    ("sag", 0.36, "Mid-line level sag detected.", "Use faster ride response through the body of the line."),
    ("end_fade", 0.35, "Sentence-end audibility loss risk detected.", "Protect endings and reduce tail-gating on clean unstable takes."),
    ("compression", 0.52, "Compressed or radio-like tone risk.", "Relax compressor ratio and mix to preserve performance movement."),
    ("click", 0.2, "Click/transient artifacts detected.", "Run click-taming cleanup and recheck consonant spikes."),
    ("echo", 0.38, "Echo/reverb tail risk detected.", "Keep room cleanup on and verify tail control plus notch behavior."),
    ("clip", 0.02, "Potential clipped peaks in source.", "Ask for a cleaner source if clipped peaks are audible."),
)
QUIET = ("No major QC risk detected.", "Source looks stable for standard optimization.")


def frames_of(ms: float, frame_ms: float) -> int:
    """Milliseconds in frames, halves upward."""
    return int(ms / frame_ms + 0.5)


def in_runs(frames: DataFrame, keys: list[str], flag: str, run: str | None = None) -> DataFrame:
    """The frames of runs, with the run's number k (from 0), start s, length len, the place a in it, and n_runs.

    `run`: a column that numbers the runs already. Only runs, one row each, are put in order by series.
    """
    d = (rn.with_run_id(frames, keys, flag) if run is None else frames.withColumnRenamed(run, "run_id")).where(flag)
    order = Window.partitionBy(*keys).orderBy("s")
    found = d.groupBy(*keys, "run_id").agg(F.min("frame_idx").alias("s"), F.count("*").alias("len"))
    before = F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")
    found = found.withColumn("k", F.row_number().over(order) - 1).withColumn("before", before).withColumn("n_runs", F.count("*").over(Window.partitionBy(*keys)))
    return with_facts(d, found, [*keys, "run_id"]).withColumn("a", F.col("frame_idx") - F.col("s"))


def _trim(length: Column) -> Column:
    """Frames that a run of this length loses at either edge before its body is measured."""
    long = F.greatest(F.lit(6), F.least(F.lit(18), F.floor(length * 0.14)))
    return F.when(length < 55, F.greatest(F.lit(1), F.least(F.lit(4), F.floor(length * 0.1)))).otherwise(long)


def _body(db: str, length: Column) -> Column:
    """Aggregate: power mean without the edges of the run's first `length` frames; null under 12 frames."""
    inner = (F.col("a") >= _trim(length)) & (F.col("a") < length - _trim(length))
    return power_mean_db(F.when((length >= 12) & inner, F.col(db)))


def edge_trimmed_bodies(placed: DataFrame, keys: list[str], db: str) -> DataFrame:
    """keys, k, s, len, body: the level of each run's body; null for runs under 12 frames."""
    return placed.groupBy(*keys, "k", "s", "len").agg(_body(db, F.col("len")).alias("body"))


def line_swing(placed: DataFrame, keys: list[str], db: str) -> DataFrame:
    """keys, swing: the 75th percentile over runs of how far and how often their parts swing."""
    d = placed.where(F.col("len") >= SWING_FRAMES).withColumn("parts", F.least(F.lit(5), F.greatest(F.lit(3), F.floor(F.col("len") / 18))))
    d = d.withColumn("part", F.floor(((F.col("a") + 1) * F.col("parts") - 1) / F.col("len")))
    means = d.groupBy(*keys, "k", "part").agg(F.avg(db).alias("m"))
    w = Window.partitionBy(*keys, "k").orderBy("part")
    steps = means.withColumn("d", F.col("m") - F.lag("m").over(w)).where(F.abs("d") >= STRONG_DB)
    turns = steps.withColumn("p", F.lag("d").over(w)).groupBy(*keys, "k").agg(F.count_if(F.col("d") * F.col("p") < 0).alias("turns"))
    spans = means.groupBy(*keys, "k").agg((F.max("m") - F.min("m")).alias("span"))
    score = unit(0.62 * unit((F.col("span") - 3) / 4.5) + 0.38 * unit((F.coalesce("turns", F.lit(0)) - 1) / 2))
    return spans.join(turns, [*keys, "k"], "left").groupBy(*keys).agg(unit(linear(score, 0.75)).alias("swing"))


def sentence_jump(placed: DataFrame, keys: list[str], db: str, frame_ms: float, duty_pct: DataFrame) -> DataFrame:
    """keys, jump: level jumps between the bodies of consecutive runs of 55 frames, weighed with the pause between them.

    duty_pct has keys and duty. Series with little speech or few runs are judged by medians and finer limits.
    """
    trim = _trim(F.col("len"))
    inner = F.when((F.col("a") >= trim) & (F.col("a") < F.col("len") - trim), F.col(db))
    d = placed.where("len >= 55").groupBy(*keys, "k", "s", "len", "n_runs").agg(F.avg(inner).alias("mean"), F.median(inner).alias("median")).join(duty_pct, keys)
    sparse = (F.col("duty") < 6) | (F.col("n_runs") <= 8)
    w = Window.partitionBy(*keys).orderBy("s")
    step = lambda c: F.abs(F.col(c) - F.lag(c).over(w))
    gap = F.greatest(F.lit(0), F.col("s") - F.lag(F.col("s") + F.col("len")).over(w))
    d = d.select(*keys, sparse.alias("sparse"), gap.alias("gap"), step("mean").alias("by_mean"), step("median").alias("by_median"))
    either = lambda a, b: F.when(F.col("sparse"), a).otherwise(b)
    d = d.where(F.col("gap") >= either(max(1, frames_of(80, frame_ms)), max(1, frames_of(120, frame_ms))))
    jump = either(F.greatest("by_median", F.col("by_mean") * 0.8), F.col("by_mean"))
    pause = unit((F.col("gap") * frame_ms - either(80, 120)) / either(700, 900))
    score = unit(unit((jump - either(1.2, 1.8)) / either(3.3, 4.2)) * either(0.9, 0.82) + pause * either(0.1, 0.18))
    return d.groupBy(*keys).agg(unit(F.when(F.max("sparse"), linear(score, 0.8)).otherwise(linear(score, 0.75))).alias("jump"))


def cold_open(placed: DataFrame, keys: list[str], db: str, frame_ms: float) -> DataFrame:
    """keys, cold_open (decibels): how far the weakest of the first runs, within the first seconds of speech, is under
    the median of the runs after them."""
    left = max(1, frames_of(HEAD_MS, frame_ms)) - F.col("before")
    opening = (F.col("k") < F.least(F.lit(HEAD_RUNS), F.greatest(F.lit(1), F.col("n_runs") - 1))) & (left > 0)
    d = placed.where("n_runs >= 2").withColumn("take", F.when(opening, F.least("len", left)))
    taken = F.coalesce("take", F.lit(0))
    runs = d.groupBy(*keys, "k", "s", "take").agg(_body(db, taken).alias("head"), _body(db, F.col("len")).alias("body"))
    end = F.max(F.col("s") + F.col("take")).over(Window.partitionBy(*keys))
    runs = runs.withColumn("later", F.when(F.col("s") >= end, F.col("body")))
    return runs.groupBy(*keys).agg(F.coalesce(F.median("later") - F.min("head"), F.lit(0.0)).alias("cold_open"))


def end_edge_dip(placed: DataFrame, keys: list[str], db: str, frame_ms: float) -> DataFrame:
    """keys, end_dip: the most by which the end of a run is under what comes just before it, at least 0."""
    tail = max(3, frames_of(TAIL_MS, frame_ms))
    body, least = max(tail, frames_of(BODY_MS, frame_ms)), tail + max(8, frames_of(120, frame_ms))
    from_end = F.col("len") - F.col("a")
    part = lambda c: power_mean_db(F.when(c, F.col(db)))
    dips = placed.where(F.col("len") >= least).groupBy(*keys, "k").agg((part((from_end > tail) & (from_end <= tail + body)) - part(from_end <= tail)).alias("dip"))
    return dips.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.max("dip")).alias("end_dip"))


def run_metrics(frames: DataFrame, keys: list[str], db: str, flag: str, frame_ms: float) -> DataFrame:
    """keys, runs, duty (percent), swing, jump, cold_open (dB), cold_open_risk, end_dip (dB): one row for each series."""
    placed = in_runs(frames, keys, flag)
    duty = frames.groupBy(*keys).agg((100 * F.avg(F.col(flag).cast("double"))).alias("duty"))
    out = duty.join(placed.groupBy(*keys).agg(F.max("n_runs").cast("long").alias("runs")), keys, "left")
    for metric in (line_swing(placed, keys, db), sentence_jump(placed, keys, db, frame_ms, duty), cold_open(placed, keys, db, frame_ms), end_edge_dip(placed, keys, db, frame_ms)):
        out = out.join(metric, keys, "left")
    out = out.fillna(0, ["runs", "swing", "jump", "cold_open", "end_dip"])
    return out.withColumn("cold_open_risk", unit((F.col("cold_open") - DIP_FLOOR_DB) / DIP_SPAN_DB))


def findings(metrics: dict[str, Column]) -> tuple[Column, Column]:
    """(flags, recommendations) as arrays in the report's order; metrics that are missing count as 0."""
    flags, advice, met = [], [], {}
    for metric, limit, flag, recommendation in FINDINGS:
        over = F.coalesce(metrics.get(metric, F.lit(0.0)), F.lit(0.0)) >= limit
        here = over & ~met[metric] if metric in met else over
        met[metric] = over
        flags.append(F.when(here, flag))
        advice.append(F.when(here, recommendation))
    one = lambda xs, quiet: F.when(F.size(F.array_compact(F.array(*xs))) > 0, F.array_compact(F.array(*xs))).otherwise(F.array(F.lit(quiet)))
    return one(flags, QUIET[0]), one(advice, QUIET[1])
