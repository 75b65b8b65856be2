"""What evidence of a source allows: authority of its speech, cleanup of an echoing room, matched levels, comparable metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import clamp, half_up, is_finite, unit

# The probability from which a frame is speech; lower end and width of the ramps of its share and seconds.
SPEECH = 0.5
SHARE_FROM, SHARE_WIDTH = 0.08, 0.22
SECONDS_FROM, SECONDS_WIDTH = 2.0, 8.0
# Echo scores, and notch cuts in dB, from which a room is dominated by its echo, or severe.
CONFIDENT = 0.5
DOMINANT, DOMINANT_HIGH, DOMINANT_MEDIUM = 0.68, (0.56, 0.72), (0.6, 0.82)
SEVERE, SEVERE_WITH_NOTCH = 0.72, (0.64, 0.98)
ENDING_NOISE, ENDING_FRAGILE, CONTINUITY_SHARE = 0.42, 0.36, 0.85
# Delays in ms that a canceller can use, its base strength, weights and limits.
DELAY_MS = (24, 90)
CANCEL_BASE, CANCEL_ECHO, CANCEL_WET, CANCEL_BIAS = 0.14, 0.22, 0.14, 0.04
CANCEL_LIMITS, BIAS_LIMITS = (0.16, 0.4), (-0.3, 0.6)


def speech_authority(frames: DataFrame, by: list[str], order: str, probability: str, start_ms: str, end_ms: str, duration_ms: str) -> DataFrame:
    """Per series: share of speech frames, seconds that they cover together, and how far either can be relied on.

    Frames may overlap; each adds what reaches beyond all speech before it in the order. Ends are held within the
    source's duration, of which the largest in a series counts; frames without finite ends add no seconds.
    """
    w = Window.partitionBy(*by).orderBy(order)
    speech = F.coalesce(F.col(probability) >= SPEECH, F.lit(False)) & ~F.isnan(F.coalesce(probability, F.lit(0.0)))
    whole = F.max(F.when(is_finite(F.col(duration_ms)), F.greatest(F.lit(0.0), duration_ms)).otherwise(0.0)).over(Window.partitionBy(*by))
    d = frames.select(*by, order, speech.alias("speech"), (speech & is_finite(F.col(start_ms)) & is_finite(F.col(end_ms))).alias("timed"), F.col(start_ms).alias("start"), F.col(end_ms).alias("end"), whole.alias("whole"))
    d = d.withColumns({c: F.when(F.col("timed"), clamp(F.col(c), 0.0, F.col("whole"))) for c in ("start", "end")})
    before = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    new = F.greatest(F.lit(0.0), F.col("end") - F.greatest("start", before))
    out = d.withColumn("new", new).groupBy(*by).agg(F.avg(F.col("speech").cast("int")).alias("speech_share"), (F.coalesce(F.sum("new"), F.lit(0.0)) / 1000).alias("speech_seconds"))
    return out.withColumns({
        "share_authority": unit((F.col("speech_share") - SHARE_FROM) / SHARE_WIDTH),
        "seconds_authority": unit((F.col("speech_seconds") - SECONDS_FROM) / SECONDS_WIDTH),
    })


def _unit_or_zero(x: Column) -> Column:
    return F.when(is_finite(x), unit(x)).otherwise(0.0)


def echo_cleanup(risk: Column, enabled: Column, keep_endings: Column, echo: Column, confidence: Column, pause_noise: Column, notch_db: Column, fade_risk: Column, continuity_risk: Column) -> Column:
    """Struct of dominant, severe, dereverb and tail_gate (the last two: allowed while endings are protected).

    Measures that are missing or not finite count as 0, a missing switch as off.
    """
    echo, confidence, pause_noise, fade_risk, continuity_risk = map(_unit_or_zero, (echo, confidence, pause_noise, fade_risk, continuity_risk))
    notch = F.greatest(F.lit(0.0), F.coalesce(notch_db, F.lit(0.0)))
    on, off = (lambda x: F.coalesce(x, F.lit(False))), (lambda at: (echo >= at[0]) & (notch >= at[1]))
    ready = on(enabled) & on(risk != "low") & (confidence >= CONFIDENT)
    high, medium = on(risk == "high"), on(risk == "medium")
    dominant = ready & ((echo >= DOMINANT) | high & off(DOMINANT_HIGH) | medium & off(DOMINANT_MEDIUM))
    severe = ready & high & ((echo >= SEVERE) | off(SEVERE_WITH_NOTCH))
    gate = on(keep_endings) & severe & (pause_noise <= ENDING_NOISE) & (F.greatest(fade_risk, continuity_risk * CONTINUITY_SHARE) < ENDING_FRAGILE)
    dereverb = severe | dominant & (echo >= DOMINANT_HIGH[0])
    return F.struct(dominant.alias("dominant"), severe.alias("severe"), dereverb.alias("dereverb"), gate.alias("tail_gate"))


def echo_cancel_strength(severe: Column, echo: Column, dryness: Column, delay_ms: Column, bias: Column) -> Column:
    """Strength of an early echo's cancelling in a severe room; 0 where its delay is missing or out of reach."""
    usable = F.coalesce(severe, F.lit(False)) & is_finite(delay_ms) & delay_ms.between(*DELAY_MS)
    strength = CANCEL_BASE + _unit_or_zero(echo) * CANCEL_ECHO + (1 - _unit_or_zero(dryness)) * CANCEL_WET + clamp(F.coalesce(bias, F.lit(0.0)), *BIAS_LIMITS) * CANCEL_BIAS
    return F.when(usable, clamp(strength, *CANCEL_LIMITS)).otherwise(0.0)


def level_match(tracks: DataFrame, by: list[str], speech: str, integrated: str) -> DataFrame:
    """tracks with metric, target_db and trim_db: all of a group are turned down to its quietest, never up.

    The level of speech serves if every track of the group has it, else the integrated one; else nothing is trimmed.
    """
    w = Window.partitionBy(*by)
    every = lambda c: F.min(is_finite(F.col(c)).cast("int")).over(w) == 1
    d = tracks.withColumn("metric", F.when(every(speech), "speech-k-weighted").when(every(integrated), "integrated-loudness").otherwise("unavailable"))
    level = F.when(F.col("metric") == "speech-k-weighted", F.col(speech)).when(F.col("metric") == "integrated-loudness", F.col(integrated))
    d = d.withColumn("target_db", F.min(level).over(w))
    return d.withColumn("trim_db", F.coalesce(F.least(F.lit(0.0), F.col("target_db") - level), F.lit(0.0)))


def metric_deltas(source: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source_value, rendered_value, delta, higher_is_better of metrics (available, value, higher_is_better) that
    both sides have, finite and of the same direction; deltas to six places, halves up."""

    def there(side: DataFrame, name: str, direction: str) -> DataFrame:
        return side.where(F.col("available") & is_finite(F.col("value"))).select(*keys, F.col("value").alias(name), F.col("higher_is_better").alias(direction))

    both = there(source, "source_value", "higher_is_better").join(there(rendered, "rendered_value", "other"), keys)
    delta = half_up((F.col("rendered_value") - F.col("source_value")) * 1e6) / 1e6
    return both.where(F.col("higher_is_better").eqNullSafe(F.col("other"))).select(*keys, "source_value", "rendered_value", delta.alias("delta"), "higher_is_better")


def deficit(value: Column, caution_at: float, severe_at: float) -> Column:
    """How far a value has fallen from the level of caution to the severe one; 0 for a missing value or equal levels."""
    return F.lit(0.0) if caution_at <= severe_at else F.coalesce(unit((caution_at - value) / (caution_at - severe_at)), F.lit(0.0))
