"""Registered queries on protected speech: a user's events as frames of 20 ms, their types as a model's probabilities."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import protection
from cadenza.plans.queries import FR, KEY, frames, query

C, MS = F.col, 20.0
#: Every fifth user's frames drift off the grid; every seventh user's report is on another one.
_P = "((event_id * 7919) % 100) / 100.0"
PROTECTED = FR + f""", rp AS (SELECT user_id, frame_idx AS frame, frame_idx * 20.0::DOUBLE + CASE WHEN user_id % 5 = 0 AND frame_idx % 29 = 28 THEN 6 ELSE frame_idx % 3 END AS a, (frame_idx + 1) * 20.0::DOUBLE AS b, {_P}::DOUBLE AS p FROM fr),
 n AS (SELECT user_id, count(*) AS n FROM fr GROUP BY user_id), mk AS (SELECT user_id, frame_idx - 2 AS i, frame_idx, value >= 40 AS en FROM fr WHERE frame_idx >= 2),
 ok AS (SELECT mk.*, p, abs(a - frame_idx * 20) <= 5 AND mk.user_id % 7 <> 0 AS ok FROM mk JOIN rp ON rp.user_id = mk.user_id AND frame = frame_idx), wh AS (SELECT *, CASE WHEN bool_and(ok) OVER (PARTITION BY user_id) THEN p END AS q FROM ok),
 mo AS (SELECT *, NOT en AND coalesce(q, 0) >= 0.58 AS mo FROM wh), ch AS (SELECT *, CASE WHEN lag(mo) OVER w IS NULL OR lag(mo) OVER w = mo THEN 0 ELSE 1 END AS c, coalesce(lag(en) OVER w, false) AS be, coalesce(lead(en) OVER w, false) AS af FROM mo WINDOW w AS (PARTITION BY user_id ORDER BY i)),
 rn AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM ch), rs AS (SELECT user_id, run, arg_min(be, i) AS le, arg_max(af, i) AS ri, count(*) AS n, min(coalesce(q, 0)) AS low FROM rn GROUP BY user_id, run),
 pt AS (SELECT rn.user_id, i, en, mo, mo AND CASE WHEN le AND ri THEN n <= 13 ELSE (le OR ri) AND n <= 8 AND low >= 0.72 END AS ad FROM rn JOIN rs USING (user_id, run))"""  # fmt: skip


def protected(spark, sf_dir):
    d = frames(spark, sf_dir)
    late = F.when((C("user_id") % 5 == 0) & (C("frame_idx") % 29 == 28), 6).otherwise(C("frame_idx") % 3)
    report = d.select("user_id", C("frame_idx").alias("frame"), (C("frame_idx") * MS + late).alias("start_ms"), ((C("frame_idx") + 1) * MS).alias("end_ms"), (((C("event_id") * 7919) % 100) / 100).alias("probability"))
    reports = d.groupBy("user_id").agg(F.count("*").alias("frames")).select("user_id", F.when(C("user_id") % 7 == 0, 10.0).otherwise(MS).alias("frame_ms"), "frames", (C("frames") * MS).alias("duration_ms"))
    mask = d.where("frame_idx >= 2").select("user_id", F.lit(0.04).alias("range_start_sec"), (C("frame_idx") - 2).alias("frame_idx"), (C("value") >= 40).alias("energy"))
    return protection.protect(protection.planner_frames(mask, report, reports, KEY, MS), KEY, MS)


@query(PROTECTED + " SELECT user_id, i::BIGINT AS frame_idx, en AS energy, en OR ad AS protected, ad AS added, mo AND NOT ad AS isolated FROM pt")
def protected_frames(spark, sf_dir):
    return protected(spark, sf_dir).select("user_id", "frame_idx", "energy", "protected", "added", "isolated")


@query(PROTECTED + ", ra AS (SELECT user_id, sum(ad::INT)::BIGINT AS added, sum((mo AND NOT ad)::INT)::BIGINT AS isolated FROM pt GROUP BY user_id) SELECT user_id, CASE WHEN added > 0 THEN 'ml-protection' ELSE 'legacy-fallback' END AS reason, added, CASE WHEN added > 0 THEN isolated ELSE 0 END::BIGINT AS isolated FROM ra")
def protected_ranges(spark, sf_dir):
    return protection.ranges(protected(spark, sf_dir), KEY).select("user_id", "reason", "added", C("isolated").cast("long").alias("isolated"))
