"""Registered queries on long sample signals: the vectors of each label, one after the other, as one signal at 4 kHz.

A tone of 181 Hz runs through all of it and jumps in phase from vector to vector; components over 0.3 stand on it as
spikes. Every vector is a chunk of 64 samples.
"""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.operators import clicks
from cadenza.plans.queries import big, query, table

C, RATE, CHUNK = F.col, 4000, 64
_R = clicks.Reach(RATE)
_TURN = 2 * math.pi * 181 / RATE
#: series, i (sample), x, total, as SQL.
SIGNAL = f"""WITH RECURSIVE v AS (SELECT label AS series, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS chunk, embedding FROM embeddings WHERE label IS NOT NULL),
 u AS (SELECT series, chunk, chunk * {CHUNK} + j - 1 AS i, j, embedding[j] AS e FROM v, (SELECT unnest(range(1, {CHUNK + 1})) AS j)),
 s AS MATERIALIZED (SELECT series, i, (0.03::DOUBLE * sin({_TURN!r}::DOUBLE * (i + chunk % 3 * 7)) + CASE WHEN abs(e) > 0.3 THEN e::DOUBLE ELSE 0 END)::FLOAT::DOUBLE AS x, count(*) OVER (PARTITION BY series) AS total FROM u)"""


def chunks(spark, sf_dir):
    """series, chunk, samples."""
    v = table(spark, sf_dir, "embeddings").where("label is not null")
    v = v.withColumn("chunk", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    tone = lambda j: 0.03 * F.sin(_TURN * (C("chunk") * CHUNK + j + C("chunk") % 3 * 7))
    x = F.transform("embedding", lambda e, j: (tone(j) + F.when(F.abs(e) > F.lit(0.3).cast("double"), e.cast("double")).otherwise(0.0)).cast("float"))
    return v.select(C("label").alias("series"), "chunk", x.alias("samples"))


_N = _R.frame
_CLICKS = SIGNAL + f""", d AS MATERIALIZED (SELECT *, x - lag(x) OVER w AS st, lag(x) OVER w AS px FROM s WINDOW w AS (PARTITION BY series ORDER BY i)),
 fb AS (SELECT series, i // {_N} AS f, x, x - (coalesce(lag(x) OVER w, x) + coalesce(lead(x) OVER w, x)) / 2 AS b FROM s WHERE i // {_N} < total // {_N} WINDOW w AS (PARTITION BY series, i // {_N} ORDER BY i)),
 fm AS (SELECT series, f, sqrt(avg(x * x)) AS rms, sqrt(avg(b * b)) + 1e-12 AS sharp FROM fb GROUP BY series, f),
 fn AS MATERIALIZED (SELECT series, f, greatest(lag(rms) OVER w, rms, lead(rms) OVER w) AS rms, greatest(lag(sharp) OVER w, sharp, lead(sharp) OVER w) AS sharp FROM fm WINDOW w AS (PARTITION BY series ORDER BY f)),
 c AS MATERIALIZED (SELECT d.*, rms, sharp FROM d JOIN fn ON d.series = fn.series AND fn.f = least(i // {_N}, total // {_N} - 1) WHERE i BETWEEN 1 AND total - 2 AND abs(st) >= greatest({clicks.LEAST_STEP}, sharp * {clicks.OVER_SHARP})),
 po AS (SELECT c.series, c.i, c.total, j.i AS j, least(abs(c.st), abs(j.st)) AS strength FROM c JOIN d j ON j.series = c.series AND j.i BETWEEN c.i + 1 AND least(c.total - 1, c.i + {_R.rest})
 WHERE abs(c.st) >= c.rms * {clicks.OVER_RMS} AND c.st * j.st < 0 AND abs(j.st) >= greatest({clicks.LEAST_STEP}, c.rms * {clicks.OVER_RMS}, c.sharp * {clicks.OVER_SHARP}) AND abs(j.x - c.px) <= least(abs(c.st), abs(j.st)) * {clicks.PULSE_BACK} + c.rms * {clicks.PULSE_BACK_RMS}),
 pu AS (SELECT DISTINCT series, i FROM (SELECT po.series, po.i, j, strength, coalesce(max(abs(k.st)), 0) AS peak FROM po LEFT JOIN d k ON k.series = po.series AND k.i BETWEEN greatest(1, po.i - {_R.around_pulse}) AND least(po.total - 1, j + {_R.around_pulse}) AND NOT k.i BETWEEN po.i - 2 AND j + 2 GROUP BY ALL)
 WHERE strength >= peak * ({clicks.PULSE_ALONE} + (j - i)::DOUBLE / {_R.rest} * {clicks.PULSE_WIDE})),
 nb AS (SELECT c.series, c.i, max(abs(k.st)) FILTER (abs(k.i - c.i) BETWEEN {_R.core + 1} AND {_R.around_edge}) AS near, count(*) FILTER (abs(k.i - c.i) > {_R.around_edge} AND abs(k.st) >= abs(c.st) * {clicks.EDGE_LIKE}) AS likes,
 count(*) FILTER (abs(k.i - c.i) > {_R.around_edge} AND abs(k.st) >= abs(c.st) * {clicks.EDGE_LIKE} AND k.st * c.st > 0) AS same FROM c JOIN d k ON k.series = c.series AND k.i BETWEEN greatest(1, c.i - {_R.far}) AND least(c.total - 1, c.i + {_R.far}) GROUP BY c.series, c.i),
 lv AS (SELECT c.series, c.i, abs(avg(k.x) FILTER (k.i >= c.i + {_R.core}) - avg(k.x) FILTER (k.i < c.i - {_R.core})) AS away FROM c JOIN s k ON k.series = c.series AND (k.i BETWEEN c.i - {_R.core + _R.far} AND c.i - {_R.core + 1} OR k.i BETWEEN c.i + {_R.core} AND c.i + {_R.core + _R.far - 1})
 WHERE c.i - {_R.core + _R.far} >= 0 AND c.i + {_R.core + _R.far} <= c.total GROUP BY c.series, c.i),
 ed AS (SELECT c.series, c.i FROM c JOIN nb USING (series, i) LEFT JOIN lv USING (series, i) WHERE (abs(st) >= coalesce(near, 0) * {clicks.EDGE_ALONE} OR coalesce(away >= greatest({clicks.LEAST_STEP}, abs(st) * {clicks.LEVEL_SHARE}), false)) AND same = 0 AND likes < 2),
 nw AS (SELECT c.series, c.i, c.total FROM c JOIN s a ON a.series = c.series AND a.i = c.i - 2 JOIN s b ON b.series = c.series AND b.i = c.i - 1 JOIN s p ON p.series = c.series AND p.i = c.i + 1 JOIN s q ON q.series = c.series AND q.i = c.i + 2 JOIN s z ON z.series = c.series AND z.i = c.i + 3
 WHERE abs(c.st) / greatest(abs(p.x - a.x), abs(q.x - b.x), abs(z.x - c.x), 1e-9) >= {clicks.SEAM_NARROW} AND least(abs(c.st - (b.x - a.x)), abs(p.x - c.x - c.st)) / abs(c.st) >= {clicks.SEAM_BEND} AND c.i >= {2 * _R.longest_lag} AND c.i + {2 * _R.longest_lag} < c.total),
 lg AS (SELECT unnest(range({_R.lags.start}, {_R.lags.stop}, {_R.lags.step})) AS lag), of AS (SELECT lag, unnest(range(0, lag, greatest(1, lag // {clicks.SEAM_POINTS}))) AS o FROM lg),
 no AS MATERIALIZED (SELECT series, i, lag, i - 2 * lag + o AS ia, i - lag + o AS ib, i + o AS ie, i + lag + o AS ig FROM nw CROSS JOIN of),
 pw AS (SELECT n.series, n.i, lag, count(*) AS n, sum(a.x * a.x) AS pa, sum(b.x * b.x) AS pb, sum(e.x * e.x) AS pc, sum(g.x * g.x) AS pd, sum(a.x * b.x) AS ab, sum(e.x * g.x) AS cd, sum(b.x * e.x) AS bc FROM no n
 JOIN s a ON a.series = n.series AND a.i = ia JOIN s b ON b.series = n.series AND b.i = ib JOIN s e ON e.series = n.series AND e.i = ie JOIN s g ON g.series = n.series AND g.i = ig GROUP BY n.series, n.i, lag),
 er AS (SELECT series, i, lag, 1 - pow(least(1, greatest(0, ab / sqrt(greatest(pa * pb, 1e-18)))), 2) AS l, 1 - pow(least(1, greatest(0, cd / sqrt(greatest(pc * pd, 1e-18)))), 2) AS r, 1 - pow(least(1, greatest(0, bc / sqrt(greatest(pb * pc, 1e-18)))), 2) AS x
 FROM pw WHERE least(pa + pb, pc + pd) / (2 * n) / greatest((pa + pb) / (2 * n), (pc + pd) / (2 * n), 1e-9) >= {clicks.SEAM_ENERGY}),
 be AS (SELECT * FROM er QUALIFY row_number() OVER (PARTITION BY series, i ORDER BY (l + r) / 2, lag) = 1),
 se AS (SELECT series, i FROM be WHERE greatest(l, r) <= {clicks.SEAM_SIDE} AND x >= {clicks.SEAM_CROSS} AND x / greatest((l + r) / 2, {1 / (clicks.SEAM_RATIO * 1000)}) >= {clicks.SEAM_RATIO}),
 al AS MATERIALIZED (SELECT * FROM pu UNION SELECT * FROM ed UNION SELECT * FROM se), ct AS (SELECT series, min(i) AS i FROM al GROUP BY series UNION ALL SELECT series, i FROM (SELECT ct.series, min(al.i) AS i FROM ct JOIN al ON al.series = ct.series AND al.i >= ct.i + {_R.rest} GROUP BY ct.series))"""  # fmt: skip


@query(_CLICKS + " SELECT series, i::BIGINT AS sample FROM ct")
def click_places(spark, sf_dir):
    """Counted clicks: pulses, edges and seams of the phase."""
    return clicks.click_places(chunks(spark, sf_dir), ["series"], RATE).select("series", "sample")


@query(_CLICKS + " SELECT series, count(i)::BIGINT AS clicks FROM (SELECT DISTINCT series FROM s) LEFT JOIN ct USING (series) GROUP BY series")
def click_counts(spark, sf_dir):
    return clicks.click_counts(chunks(spark, sf_dir), ["series"], RATE).select("series", big("clicks").alias("clicks"))
