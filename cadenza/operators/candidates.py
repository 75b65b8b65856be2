"""Gates and fallbacks of render candidates, as columns over rows of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import is_finite

# Gate reasons by what they bear on, degrade reasons that leave the audio as it is, render paths of
# segmented audio, variants and paths in order of preference, strategies by label.
TECHNICAL = ["duration-mismatch", "timing-offset", "peak-violation", "planner-required", "planner-apply-failed"]
STRUCTURAL = ["duration-mismatch", "timing-offset", "peak-violation"]
PLANNER = ["planner-required", "planner-apply-failed"]
LINEAR_RECOVERY = ["ending-damage", "end-edge-dip", "source-regression"]
QC_ONLY = ["analysis-window-retry", "analysis-window-drop", "qc-unavailable"]
SEGMENTED = ["speech-pause-segmented", "speech-aligned-segmented", "fixed-segmented"]
VARIANTS = {"cinematic-stable": 0, "continuity-safe": 1, "pause-safe": 2, "source-safe": 3, "core-safe": 3}
PATHS = {"fixed-segmented": 0, "speech-pause-segmented": 1, "speech-aligned-segmented": 1, "single-pass": 2}
TAIL_SAFE, AUDIBILITY_SAFE = "planner-tail-safe single-pass", "audibility-safe single-pass"
SCORES = ["stability", "pause", "compression", "echo"]


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _any(reasons: Column, of: list[str]) -> Column:
    return F.exists(reasons, lambda x: x.isin(of))


def technical_reasons(reasons: Column) -> Column:
    """Reasons that bear on safety, in their order, repeats kept."""
    return F.filter(reasons, lambda x: x.isin(TECHNICAL))


def advisory_reasons(reasons: Column) -> Column:
    return F.filter(reasons, lambda x: ~x.isin(TECHNICAL))


def wants_linear_recovery(reasons: Column) -> Column:
    return F.size(F.array_except(_array(LINEAR_RECOVERY), reasons)) == 0


def wants_source_safe(reasons: Column, degraded: Column) -> Column:
    return _any(reasons, STRUCTURAL) | F.array_contains(degraded, "audibility-dropout-guard")


def healthy_segmented(path: Column, healthy: Column) -> Column:
    return healthy & path.isin(SEGMENTED)


def measurement_status(windows: list[Column], evidence: list[Column]) -> Column:
    """partial where windows were sampled or a measure is missing, else measured."""
    sampled, whole = F.lit(False), F.lit(True)
    for w in windows:
        sampled = sampled | F.coalesce(w > 0, F.lit(False))
    for e in evidence:
        whole = whole & is_finite(e)
    return F.when(sampled | ~whole, "partial").otherwise("measured")


def delivers_enhanced(reasons: Column) -> Column:
    return F.size(technical_reasons(reasons)) == 0


def advisory_preference(previous: Column, enhanced: Column) -> Column:
    """The candidate of the lower ranking score, tie, or unavailable; advice only."""
    both = is_finite(previous) & is_finite(enhanced)
    return F.when(~both, "unavailable").when(enhanced < previous, "enhanced").when(enhanced > previous, "previous").otherwise("tie")


def explain_delta(winner: str, loser: str) -> Column:
    """What parts two scores, structs with rank and SCORES: the first that differs."""
    a, b = F.col(f"{winner}.rank"), F.col(f"{loser}.rank")
    out = F.when(a.isNotNull() & b.isNotNull() & (a != b), "winner by learned ranking")
    for s in SCORES:
        out = out.when(F.col(f"{winner}.{s}") != F.col(f"{loser}.{s}"), f"winner by raw {s} delta")
    return out.otherwise("winner by raw total delta")


def next_fallback(labels: Column, current: Column) -> Column:
    """The place, from 0, of the strategy after `current`: one that is safe by label if it lies ahead, else the next."""
    ahead = lambda label: F.array_position(labels, label) - 1
    out = F.when((current < 0) | (current >= F.size(labels) - 1), None)
    for label in (TAIL_SAFE, AUDIBILITY_SAFE):
        out = out.when(ahead(label) > current, ahead(label))
    return out.otherwise(current + 1).cast("int")


def planner_outcome(usable: Column, speech: Column) -> Column:
    return F.when(usable, "use-plan").when(speech, "render-source-preserving").otherwise("bypass-nonspeech")


def high_render_risk(seconds: Column, sparse: Column, segments: Column, spans: Column, cleans: Column, failed: Column) -> Column:
    """Whether a render is likely to break: many segments, long and sparse, many spans under clean-up, or a failure before."""
    return (segments >= 24) | ((seconds >= 480) & sparse) | ((spans >= 18) & cleans) | failed


def long_form(seconds: Column, estimated: Column, budget: float = 4800.0) -> Column:
    known = F.when(is_finite(seconds), seconds).otherwise(estimated)
    return F.coalesce(is_finite(known) & (known > budget), F.lit(False))


def _priority(x: Column, order: dict[str, int], other: int) -> Column:
    return F.coalesce(*(F.when(x == name, place) for name, place in order.items()), F.lit(other))


def choose_unmeasured(candidates: DataFrame, by: list[str]) -> DataFrame:
    """For each group the best candidate that has audio but no quality report and no planner gate, with the reason.

    candidates: index, has_audio, gates, degraded, path, healthy, variant, rank and the scores with total. Scores compare
    by rank where both have one; as that is no total order, those without a rank come after all others here.
    """
    open_ = candidates.where(F.col("has_audio") & F.array_contains("gates", "qc-unavailable") & ~_any(F.col("gates"), PLANNER))
    broken = F.exists("degraded", lambda x: ~x.isin(QC_ONLY))
    sound = healthy_segmented(F.col("path"), F.col("healthy"))
    keys = [broken, ~sound, F.col("path") == "single-pass-recovered", _priority(F.col("variant"), VARIANTS, 4), _priority(F.col("path"), PATHS, 3)]
    keys += [F.col("rank").asc_nulls_last(), *map(F.col, SCORES), F.col("total"), F.col("index")]
    best = open_.withColumn("__place", F.row_number().over(Window.partitionBy(*by).orderBy(*keys))).where("__place = 1").drop("__place")
    plain = F.when(sound, "QC-unavailable fallback from healthy rendered segmented audio").otherwise("QC-unavailable fallback from rendered audio")
    worse = "QC-unavailable fallback with render degradation because no cleaner rendered candidate was available"
    return best.withColumn("reason", F.when(broken, worse).otherwise(plain))
