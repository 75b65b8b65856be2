"""Registered queries on spectra: the vectors of each label, five at a time, as frames of 20 ms at 16 kHz."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import spectrum as sp
from cadenza.plans.queries import query, r, table

C, RATE, N, KEYS = F.col, 16_000, 320, ["series"]
_GRID = ", ".join(f"({b}, {float(hz)!r}::DOUBLE)" for b, row in enumerate(sp.probes(RATE)) for hz in row)
#: fr: frames (series, f, samples as rows), bp: their band powers; he: which are heard (activity of 10 ms, two in three of them).
SPECTRA = f"""WITH v AS (SELECT label AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS c, embedding FROM embeddings WHERE label IS NOT NULL),
 w AS (SELECT series, c // 5 AS f, c % 5 * 64 + j - 1 AS i, embedding[j]::DOUBLE AS x FROM v, (SELECT unnest(range(1, 65)) AS j)), fr AS MATERIALIZED (SELECT *, x * 0.5::DOUBLE * (1 - cos(2 * pi() * i / {N - 1})) AS y FROM w WHERE (series, f) IN (SELECT series, f FROM w GROUP BY ALL HAVING count(*) = {N})),
 rm AS (SELECT series, f, sqrt(avg(x * x)) AS rms FROM fr GROUP BY series, f), gr(b, hz) AS (VALUES {_GRID}), dp AS (SELECT series, f, b, hz, pow(sum(y * cos(2 * pi() * hz * i / {RATE})), 2) + pow(sum(y * sin(2 * pi() * hz * i / {RATE})), 2) AS p FROM fr, gr GROUP BY ALL),
 bp AS MATERIALIZED (SELECT series, f, b, avg(p) / {N * N} AS p FROM dp GROUP BY ALL), he AS (SELECT series, f, rms, (series + 2 * f) % 3 <> 0 OR (series + 2 * f + 1) % 3 <> 0 AS h FROM rm),
 rk AS (SELECT *, sum(h::INT) OVER (PARTITION BY series ORDER BY f) - 1 AS pos, sum(h::INT) OVER (PARTITION BY series) AS nh, count(*) OVER (PARTITION BY series) AS n FROM he)"""  # fmt: skip


def frames(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    v = v.select(C("label").alias("series"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("c"), "embedding")
    f = v.groupBy("series", F.floor(C("c") / 5).alias("frame_idx")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("c", "embedding"))), lambda s: s["embedding"])).alias("samples"))  # five vectors each
    f = f.where(F.size("samples") == N)
    ticks = f.select("series", F.explode(F.array(C("frame_idx") * 2, C("frame_idx") * 2 + 1)).alias("activity_idx")).withColumn("active", (C("series") + C("activity_idx")) % 3 != 0)
    return sp.overlapping(f, ticks, KEYS, RATE, 10.0)


_BANDS = SPECTRA + ", g AS (SELECT series, f FROM rk WHERE h AND pos % greatest(1, ceil(nh / 4.0)) = 0 AND rms >= 1e-4), m AS (SELECT series, b, 10 * log10(avg(p) + 1e-30) AS db, count(*) AS n FROM bp JOIN g USING (series, f) GROUP BY series, b)"


@query(_BANDS + " SELECT series, list(round(db, 6) ORDER BY b) AS band_db, any_value(n)::BIGINT AS counted, true AS gated FROM m GROUP BY series")
def log_band_spectrum(spark, sf_dir):
    """Levels in eight bands over at most four heard frames a series."""
    d = sp.log_band_spectrum(frames(spark, sf_dir), KEYS, RATE, 4)
    return d.select("series", F.transform("band_db", lambda x: F.round(x, 6)).alias("band_db"), "counted", "gated")


@query(SPECTRA + f""", ev AS (SELECT * FROM rk WHERE h AND (nh <= 5 OR pos IN (SELECT floor(k * (nh - 1) / 4.0 + 0.5) FROM range(5) t(k)))), l AS (SELECT series, f, list(10 * log10(p + 1e-30) ORDER BY b) AS db FROM bp GROUP BY series, f),
 s AS (SELECT ev.series, CASE WHEN rms >= 1e-4 THEN least(1, greatest(0, ((db[7] + db[8] - db[5] - db[6]) / 2 + 1) / 9)) ELSE 0 END AS x FROM ev JOIN l ON l.series = ev.series AND l.f = ev.f), a AS (SELECT series, least({sp.MOST_AUTHORITY}, sqrt(avg(x * x))) AS a FROM s GROUP BY series)
 SELECT series, round(a, 6) AS authority, round(-4 * a * a, 6) AS main_db, round(-2.4 * a * a, 6) AS second_db FROM a""")  # fmt: skip
def event_sibilance(spark, sf_dir):
    """Sibilance of five heard frames, evenly over the series, and the cuts that follow from it."""
    d = sp.event_sibilance(frames(spark, sf_dir), KEYS, RATE, 5).withColumn("c", sp.de_esser_cuts(C("authority")))
    return d.select("series", r("authority").alias("authority"), r("c.main_db").alias("main_db"), r("c.second_db").alias("second_db"))


@query(_BANDS + """, rf AS (SELECT b, median(db) AS ref FROM m GROUP BY b), d AS (SELECT series, b, ref - db AS x FROM m JOIN rf USING (b)), o AS (SELECT *, x - avg(x) OVER (PARTITION BY series) AS raw FROM d),
 k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY abs(raw) DESC, b) AS rank FROM o) SELECT series, list(round(greatest(CASE WHEN rank <= 2 THEN -2 ELSE -1 END, least(CASE WHEN rank <= 2 THEN 2 ELSE 1 END, raw)), 6) ORDER BY b) AS delta_db FROM k GROUP BY series""")  # fmt: skip
def tone_match(spark, sf_dir):
    """What brings each series to the median tone of all: one decibel a band, two for the two bands farthest off."""
    d = sp.log_band_spectrum(frames(spark, sf_dir), KEYS, RATE, 4)
    middle = d.agg(*(F.median(C("band_db")[k]) for k in range(len(sp.BANDS)))).first()  # a number a band
    delta = sp.tone_delta(C("band_db"), F.array(*(F.lit(x).cast("double") for x in middle)), 1.0, priority=2, priority_most=2.0)
    return d.select("series", F.transform(delta, lambda x: F.round(x, 6)).alias("delta_db"))
