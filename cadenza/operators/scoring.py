"""Rule-based scores, gates, assessments and verdicts, as column expressions over one wide row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.scalar import clamp, null_aware_mean, unit

#: Weights of the composite categories and of the overall risk. The risk weights sum to 1.16, then clamp.
STABILITY = {"instability": 0.24, "onset": 0.16, "jump": 0.20, "swing": 0.12, "sag": 0.12, "end_fade": 0.10, "breath": 0.06}
PAUSE = {"pause": 0.58, "breath": 0.24, "click": 0.18}
RISK = {"instability": 0.13, "onset": 0.08, "sag": 0.08, "end_fade": 0.08, "swing": 0.08, "jump": 0.10, "breath": 0.10, "compression": 0.14, "pause": 0.13, "click": 0.10, "echo": 0.08, "clip": 0.06}
WARN = {"overall": 0.56, "instability": 0.74, "pause": 0.72, "click": 0.66}
#: Packing of the composite's categories, and the total of a row without any measurement.
PACK, UNMEASURED = (1000, 100, 10, 1), 1111.0


def composite(stability: Column, pause: Column, compression: Column, echo: Column) -> Column:
    """1000 s + 100 p + 10 c + e; a missing category counts as the mean of those measured, a row of none as UNMEASURED."""
    parts = (stability, pause, compression, echo)
    mean = null_aware_mean(*((p, 1.0) for p in parts))
    total = sum((F.coalesce(p, mean) * w for p, w in zip(parts, PACK)), F.lit(0.0))
    return F.coalesce(total, F.lit(UNMEASURED))


def category(weights: dict[str, float]) -> Column:
    return null_aware_mean(*((F.col(c), w) for c, w in weights.items()))


def overall_risk() -> Column:
    return unit(sum((F.col(c) * w for c, w in RISK.items()), F.lit(0.0)))


def report_status() -> Column:
    over = F.lit(False)
    for c, limit in WARN.items():
        over = over | (F.col(c) >= limit)
    return F.when(over, "warning").otherwise("ok")


def instability(p80: Column, p95: Column, many: Column, least: int = 12) -> Column:
    """Score of the absolute frame steps from their 80th and 95th percentiles; 0 below `least` steps."""
    score = 0.62 * unit((p80 - 1.2) / 3.1) + 0.38 * unit((p95 - 2.2) / 4.6)
    return F.when(many >= least, unit(score)).otherwise(0.0)


def compression_risk(dynamic_range: Column, crest: Column) -> Column:
    return unit(0.68 * unit((10.2 - dynamic_range) / 5.2) + 0.32 * unit((11.5 - crest) / 5.8))


def pause_risk(noise_floor: Column, contrast: Column, breath: Column) -> Column:
    return unit(0.5 * unit((noise_floor + 62) / 18) + 0.35 * unit((22 - contrast) / 14) + 0.15 * breath)


def gate_penalty(duration_delta: Column, offset: Column, confidence: Column, peak_db: Column, ending: Column) -> Column:
    """Sum of the gates that a candidate misses; a missing measurement opens its gate."""
    gates = (
        F.when(F.abs(duration_delta) > 0.05, F.abs(duration_delta) * 5200),
        F.when((confidence >= 0.35) & (F.abs(offset) > 0.08), F.abs(offset) * 2600 * clamp(confidence, 0.25, 1.0)),
        F.when(peak_db > -1.5, (peak_db + 1.5) * 900),
        F.when(ending > 0.62, (ending - 0.62) * 1400),
    )
    return sum((F.coalesce(g, F.lit(0.0)) for g in gates), F.lit(0.0))


def assessment_risk(critical_fails: Column, fails: Column, major_warns: Column, warns: Column, penalty: Column, learned: Column) -> Column:
    findings = critical_fails * 1.2 + fails * 0.8 + major_warns * 0.35 + warns * 0.18
    return findings + F.least(F.lit(1.5), penalty / 1500) + F.greatest(F.lit(0.0), learned / 250)


def verdict(critical_fails: Column, fails: Column, risk: Column, challenger_risk: Column) -> Column:
    """fail / challenger / pass: of a selected candidate, and of a rival that may be missing."""
    failed = (critical_fails >= 1) | (critical_fails + fails >= 2) | (risk >= 2.1)
    gap = risk - challenger_risk
    better = (gap >= 0.22) | (failed & (challenger_risk + 0.05 < risk))
    return F.when(F.coalesce(better, F.lit(False)), "challenger").when(failed, "fail").otherwise("pass")


def vote_weight(duration_sec: Column) -> Column:
    return clamp(F.sqrt(duration_sec / 120), 0.5, 2.0)


def batch_offset(anchor: Column, level: Column, files: Column, trigger: float = 0.5, most: float = 2.0) -> Column:
    """How far to move a level to the batch's anchor; 0 below the trigger, or without two files to anchor on."""
    gap = anchor - level
    return F.when((files >= 2) & (F.abs(gap) > trigger), clamp(gap, -most, most)).otherwise(0.0)
