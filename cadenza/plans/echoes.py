"""Registered queries on echoes: taps and blends of the long sample signals, gains on the tails of the long series' speech."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import echo
from cadenza.plans.quality_reports import KEYS, LONG, long_series
from cadenza.plans.queries import query, r
from cadenza.plans.sample_signals import CHUNK, SIGNAL, chunks
from cadenza.sources.tables import kept

C, DELAY = F.col, 100
_TAP = SIGNAL + f""", pr AS (SELECT a.series, a.i, a.x, b.x AS b FROM s a JOIN s b ON b.series = a.series AND b.i = a.i - {DELAY}),
 tp AS (SELECT series, least({echo.TAP_HIGH}, greatest({echo.TAP_LOW}, coalesce(sum(x * b) FILTER (k), 0) / (coalesce(sum(b * b) FILTER (k), 0) + 1e-9))) AS tap FROM (SELECT *, (i - {DELAY}) % {echo.STRIDE} = 0 AND abs(x) >= {echo.QUIET} AS k FROM pr) GROUP BY series)"""  # fmt: skip


def _frames(spark, sf_dir):
    return chunks(spark, sf_dir).withColumnRenamed("chunk", "frame_idx")


@query(_TAP + " SELECT series, round(tap, 6) AS tap FROM tp")
def echo_taps(spark, sf_dir):
    return echo.residual_tap(_frames(spark, sf_dir), ["series"], CHUNK, DELAY).select("series", r("tap").alias("tap"))


@query(_TAP + f""", bl AS (SELECT s.series, s.i // {CHUNK} AS f, CASE WHEN abs(tap) >= {echo.LEAST_TAP} AND b IS NOT NULL THEN greatest(-1, least(1, s.x - {echo.MIX} * tap * b)) ELSE s.x END AS y FROM s JOIN tp USING (series) LEFT JOIN pr ON pr.series = s.series AND pr.i = s.i)
 SELECT series, f::INT AS frame_idx, round(sum(y), 6) AS total, round(sum(y * y), 6) AS energy FROM bl GROUP BY series, f""")  # fmt: skip
def echo_blend(spark, sf_dir):
    """Sum and energy of each frame once the echo is taken out."""
    frames = _frames(spark, sf_dir)
    taps = echo.residual_tap(frames, ["series"], CHUNK, DELAY)
    d = echo.delay_blend(frames, taps, ["series"], CHUNK, DELAY)
    total = lambda f: F.aggregate("samples", F.lit(0.0), lambda s, v: s + f(v))
    return d.select("series", "frame_idx", r(total(lambda v: v)).alias("total"), r(total(lambda v: v * v)).alias("energy"))


_O = echo.FINISH
TAILS = LONG.replace("WITH fr AS", "WITH RECURSIVE fr AS", 1) + f""", lw AS (SELECT user_id, frame_idx AS i, db, active AS sp, CASE WHEN lag(active) OVER w IS NULL OR lag(active) OVER w = active THEN 0 ELSE 1 END AS g FROM mk WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
 li AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY i) AS run FROM lw), lz AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS sz, i - min(i) OVER (PARTITION BY user_id, run) + 1 AS inn, quantile_cont(db, 0.85) OVER (PARTITION BY user_id) AS body FROM li),
 ls AS (SELECT *, i - last_value(CASE WHEN sp THEN i END IGNORE NULLS) OVER w AS since, last_value(CASE WHEN sp THEN sz END IGNORE NULLS) OVER w AS prun, i - last_value(CASE WHEN sp AND db >= body - 8 THEN i END IGNORE NULLS) OVER w AS aw,
 coalesce(bool_or(db >= body - 8) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 25 FOLLOWING), false) AS coming FROM lz WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 ta AS MATERIALIZED (SELECT user_id, i, CASE WHEN NOT sp AND prun >= 5 AND since >= 1 THEN greatest(0.015, 1 - 0.985 * least(1, (since - 1) / 4.0)) ELSE 1 END::DOUBLE AS st,
 CASE WHEN sp AND db < body - 8 AND inn >= 6 AND coalesce(aw, i + 10000) >= 12 AND db <= body - 10 AND NOT coming THEN greatest(0.1, 1 - 0.9 * least(1, (coalesce(aw, i + 10000) - 12) / 8.0)) WHEN NOT sp AND prun >= 6 AND since >= 12 THEN greatest(0.1, 1 - 0.9 * least(1, (since - 12) / 8.0)) ELSE 1 END::DOUBLE AS ft FROM ls),
 gn AS (SELECT user_id, -1::BIGINT AS i, 1::DOUBLE AS st, 1::DOUBLE AS ft, 1::DOUBLE AS sg, 1::DOUBLE AS fg FROM (SELECT DISTINCT user_id FROM ta) UNION ALL
 SELECT ta.user_id, ta.i, ta.st, ta.ft, sg + (ta.st - sg) * CASE WHEN ta.st < sg THEN 0.99 ELSE 0.68 END, fg + (ta.ft - fg) * CASE WHEN ta.ft < fg THEN 0.3 ELSE 0.16 END FROM gn JOIN ta ON ta.user_id = gn.user_id AND ta.i = gn.i + 1)"""  # fmt: skip


@query(TAILS + " SELECT user_id AS series, i::BIGINT AS frame_idx, round(st, 6) AS strict_target, round(sg, 6) AS strict_gain, round(ft, 6) AS finish_target, round(fg, 6) AS finish_gain FROM gn WHERE i >= 0")
def tail_gains(spark, sf_dir):
    """Targets and gains of the strict and of the finishing pass, at frames of 10 ms."""
    d = long_series(spark, sf_dir).select("series", "frame_idx", "db", C("active").alias("speech"), "run_id")
    d = echo.strict_targets(d, KEYS, run="run_id").withColumnRenamed("target", "strict_target")
    d = kept(echo.finishing_targets(d, KEYS, 10.0, run="run_id").withColumnRenamed("target", "finish_target").drop("run_id"), "targets")
    d = echo.asymmetric(d, KEYS, "strict_target", echo.STRICT["attack"], echo.STRICT["release"], "strict_gain")
    d = echo.asymmetric(d, KEYS, "finish_target", _O["attack"], _O["release"], "finish_gain")
    return d.select("series", "frame_idx", *(r(c).alias(c) for c in ("strict_target", "strict_gain", "finish_target", "finish_gain")))
