"""How loud the speech of a file is, and of a group of files, from measured windows; and where windows go.

Medians are weighted through midpoints, by seconds of speech where every window tells them. A level that is missing or not
finite takes no part; a file or group without any has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc

C = F.col
#: Usable windows needed; seconds of speech from which plateaus count, and in full; seconds that are heard
#: whole, windows beyond them (seconds, number), and those of long files.
LEAST_WINDOWS, FROM_SECONDS, FULL_SECONDS = 4, 1.0, 15.0
WHOLE_SECONDS, WINDOW_SECONDS, WINDOWS = 180, 30, 6
LONG_SECONDS, LONG_WINDOW_SECONDS, LONG_WINDOWS, MOST_WINDOWS = 720, 15, 13, 24


def _authority(seconds: Column, evidence: Column) -> Column:
    return F.when(seconds > 0, sc.smooth_ramp(seconds, FROM_SECONDS, FULL_SECONDS)).otherwise(sc.smooth_ramp(evidence, 0.5, 1.0))


def _vote(seconds: Column, evidence: Column) -> Column:
    return F.when(seconds > 0, sc.clamp(F.sqrt(seconds / 120), 0.5, 2.0)).otherwise(sc.clamp(evidence, 0.5, 2.0))


def file_levels(windows: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, level, plateau, authority, vote, seconds, frames from windows with speech_db, plateau_db, frames, seconds and
    frame_ms; `order` tells windows of equal plateaus apart."""
    d = windows.where(sc.is_finite(C("speech_db")))
    some = lambda x: sc.is_finite(x.cast("double")) & (x > 0)
    told = F.when(some(C("seconds")), C("seconds")).when(some(C("frames")) & some(C("frame_ms")), C("frames") * C("frame_ms") / 1000)
    d = d.withColumn("__flat", F.coalesce(sc.is_finite(C("plateau_db")) & some(C("frames")), F.lit(False))).withColumn("__told", F.when(C("__flat"), told))
    flat, known = F.count(F.when(C("__flat"), 1)), F.count("__told")
    total = d.groupBy(*by).agg(
        F.median("speech_db").alias("level"), F.count("*").alias("__n"), ((flat > 0) & (flat == known)).alias("__all"), F.sum("__told").alias("__told_sum"),
        F.coalesce(F.sum(F.when(C("__flat"), C("frames"))), F.lit(0)).alias("frames"),
    )
    weighed = d.where("__flat").join(total.select(*by, "__all"), by).withColumn("__w", F.when(C("__all"), C("__told")).otherwise(1.0))
    out = total.join(pct.weighted_midpoint(weighed, by, "plateau_db", "__w", 0.5, "plateau", order), by, "left")
    seconds = F.when(C("__all"), C("__told_sum")).otherwise(0.0)
    evidence = sc.clamp(C("__n") / LEAST_WINDOWS, 0.5, 2.0)
    return out.select(*by, "level", F.coalesce("plateau", "level").alias("plateau"), _authority(seconds, evidence).alias("authority"), _vote(seconds, evidence).alias("vote"), seconds.alias("seconds"), "frames")


def group_levels(files: DataFrame, by: list[str], order: str) -> DataFrame:
    """The same columns of groups from those of their files; `order` tells files of equal levels apart.

    Files weigh by seconds if all have some, by frames if none has and all have frames, else alike.
    """
    d = files.where(sc.is_finite(C("level")) & sc.is_finite(C("plateau")))
    timed, framed = F.coalesce(C("seconds") > 0, F.lit(False)), F.coalesce(C("frames") > 0, F.lit(False))
    total = d.groupBy(*by).agg(
        F.every(timed).alias("__timed"), F.every(~timed).alias("__untimed"), F.every(framed).alias("__framed"), F.sum("seconds").alias("__sum"), F.median("plateau").alias("__middle"),
        F.sum(F.when(framed, C("frames")).otherwise(0)).alias("frames"), F.avg(F.coalesce("vote", F.lit(1.0))).alias("__vote"), F.avg(F.coalesce(sc.unit(C("authority")), F.lit(1.0))).alias("__authority"),
    )
    weight = F.when(C("__timed"), C("seconds")).when(C("__untimed") & C("__framed"), C("frames")).otherwise(1).cast("double")
    d = d.join(total.select(*by, "__timed", "__untimed", "__framed"), by).withColumn("__w", weight)
    level = pct.weighted_midpoint(d, by, "level", "__w", 0.5, "level", order)
    plateau = pct.weighted_midpoint(d.where(framed), by, "plateau", "__w", 0.5, "plateau", order)
    seconds = F.when(C("__timed"), C("__sum")).otherwise(0.0)
    authority = F.when(C("__timed"), _authority(seconds, C("__vote"))).when(C("__untimed"), sc.unit(C("__authority"))).otherwise(0.0)
    out = total.join(level, by).join(plateau, by, "left")
    return out.select(*by, "level", F.coalesce("plateau", "__middle").alias("plateau"), authority.alias("authority"), _vote(seconds, C("__vote")).alias("vote"), seconds.alias("seconds"), "frames")


def alignment_level(level: Column, plateau: Column, authority: Column) -> Column:
    """The level that counts when files are aligned: as far towards the plateau as there is speech to trust it."""
    return F.coalesce(level + sc.unit(authority) * (plateau - level), plateau, level)


def even_windows(seconds: Column) -> Column:
    """Where to listen in a file of known length: array of (start, seconds), evenly from its start to its end.

    Up to three minutes it is one window; null or no length gives none.
    """
    long = seconds > LONG_SECONDS
    size = F.when(long, LONG_WINDOW_SECONDS).otherwise(WINDOW_SECONDS).cast("double")
    many = F.when(long, F.least(F.lit(MOST_WINDOWS), F.greatest(F.lit(LONG_WINDOWS), F.ceil(seconds / 60)))).otherwise(WINDOWS).cast("int")
    one = lambda start, length: F.struct(start.alias("start"), length.alias("seconds"))
    spread = F.transform(F.sequence(F.lit(0), many - 1), lambda k: one(F.round((seconds - size) * k / (many - 1), 6), size))
    none = F.array().cast("array<struct<start:double,seconds:double>>")
    return F.when(~sc.is_finite(seconds) | (seconds <= 0), none).when(seconds <= WHOLE_SECONDS, F.array(one(F.lit(0.0), seconds))).otherwise(spread)


def enough(windows: Column, usable: Column, seconds: Column) -> Column:
    """Whether usable windows tell enough of a file: four of them, or one if the file was heard whole."""
    only = F.get(windows, F.lit(0))
    whole = (F.size(windows) == 1) & (only["start"] <= 0.001) & (only["start"] + only["seconds"] >= seconds - 0.001)
    return F.coalesce((usable >= 1) & (whole | (usable >= LEAST_WINDOWS)), F.lit(False))
