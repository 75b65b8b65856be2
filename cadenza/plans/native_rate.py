"""Registered queries at a signal's own rate, on the long sample signals: frames of 9.2 samples over chunks of 64."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import consonants
from cadenza.plans.queries import query, r
from cadenza.plans.sample_signals import CHUNK, RATE, SIGNAL, chunks

C, MS, REACH = F.col, 2.3, 20
_DB = "CASE WHEN {0} > 0 THEN 20 * log10({0}) ELSE -120 END"
FRAMES = SIGNAL + f""", bd AS (SELECT series, k, floor(k * {RATE * MS / 1000}::DOUBLE + 0.5)::BIGINT AS i FROM (SELECT DISTINCT series, total FROM s), LATERAL (SELECT unnest(range(0, total)) AS k) WHERE floor(k * {RATE * MS / 1000}::DOUBLE + 0.5) < total),
 nf AS (SELECT s.series, bd.k, count(*) AS many, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM s ASOF JOIN bd ON bd.series = s.series AND s.i >= bd.i GROUP BY s.series, bd.k),
 nd AS (SELECT series, k, many, {_DB.format("rms")} AS rd, {_DB.format("peak")} AS pd FROM nf)"""  # fmt: skip


def native(spark, sf_dir):
    d = chunks(spark, sf_dir).withColumn("start", C("chunk") * CHUNK)
    return consonants.native_frames(d, ["series"], RATE, MS)


@query(FRAMES + " SELECT series, k::BIGINT AS frame_idx, many AS samples, round(rd, 6) AS rms_db, round(pd, 6) AS peak_db FROM nd")
def native_frames(spark, sf_dir):
    return native(spark, sf_dir).select("series", "frame_idx", "samples", r("rms_db").alias("rms_db"), r("peak_db").alias("peak_db"))


@query(FRAMES + f""", lv AS (SELECT a.series, a.k, any_value(a.rd) AS rd, list_sort(list(b.rd) FILTER (b.rd >= -58)) AS l FROM nd a JOIN nd b ON b.series = a.series AND abs(b.k - a.k) <= {REACH} GROUP BY a.series, a.k)
 SELECT series, k::BIGINT AS frame_idx, round(coalesce(l[(floor(greatest(1, ceil(len(l) * 0.72::DOUBLE)) * 0.6::DOUBLE) + 1)::BIGINT], rd), 6) AS body FROM lv""")  # fmt: skip
def consonant_bodies(spark, sf_dir):
    d = native(spark, sf_dir)
    return d.select("series", "frame_idx", r(consonants.local_body("rms_db", ["series"], REACH)).alias("body"))


@query(FRAMES + """, cp AS (SELECT series, k, greatest(0, pd - rd - 5.5) AS c FROM nd), cn AS (SELECT *, row_number() OVER w AS p, count(*) OVER (PARTITION BY series) AS n,
 coalesce(lag(c, 2) OVER w, 0) + 2 * coalesce(lag(c) OVER w, 0) + 3 * c + 2 * coalesce(lead(c) OVER w, 0) + coalesce(lead(c, 2) OVER w, 0) AS sp FROM cp WINDOW w AS (PARTITION BY series ORDER BY k)),
 hd AS (SELECT *, CASE WHEN p <= 2 OR p > n - 2 THEN c WHEN c <= 0 THEN 0 ELSE c * pow(least(1, sp / (9 * c)), 4) END AS h FROM cn), br AS (SELECT *, lag(h) OVER w AS h0, lead(h) OVER w AS h1, lag(c) OVER w AS c0, lead(c) OVER w AS c1 FROM hd WINDOW w AS (PARTITION BY series ORDER BY k))
 SELECT series, k::BIGINT AS frame_idx, round(c, 6) AS asked, round(CASE WHEN n >= 5 AND c <= 0 AND c0 > 0 AND c1 > 0 THEN least(h, least(h0, h1) * 0.4) ELSE h END, 6) AS cap FROM br""")  # fmt: skip
def consonant_caps(spark, sf_dir):
    d = native(spark, sf_dir).withColumn("asked", F.greatest(F.lit(0.0), C("peak_db") - C("rms_db") - 5.5))
    return consonants.relax_caps(d, ["series"], "asked").select("series", "frame_idx", r("asked").alias("asked"), r("cap").alias("cap"))
