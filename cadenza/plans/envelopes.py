"""Registered queries on the comparison of two envelopes: the long series before, and flattened, tilted and two frames late after.

Frames are 20 ms; speech is the mask of the quality report's long series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions.percentiles import linear
from cadenza.operators import envelopes as env
from cadenza.operators import masks, runs
from cadenza.plans.quality_reports import KEYS, LONG, long_series
from cadenza.plans.queries import query, r, table
from cadenza.sources.tables import kept

C, MS = F.col, 20.0
#: su: frames of both envelopes in the source's time, with speech and support.
PAIRED = LONG + """, bb AS (SELECT fr.user_id, fr.frame_idx AS i, event_id, fr.db AS sf, fr.db + 3 + event_id % 5 AS sp, fr.db - 2 - event_id % 3 AS sb, 0.8 * fr.db + (event_id % 7) * 0.3 + (fr.frame_idx % 400) * 0.01 AS cf, active AS speech FROM fr JOIN mk ON fr.user_id = mk.user_id AND fr.frame_idx = mk.frame_idx),
 sm AS (SELECT user_id, median(sb) FILTER (speech) AS mid, count(*) FILTER (speech) AS many, count(*) AS n FROM bb GROUP BY user_id),
 su AS MATERIALIZED (SELECT bb.*, cf + 3 + event_id % 4 AS cp, cf - 2 - event_id % 2 AS cb, n, CASE WHEN many >= 20 THEN speech AND sb >= mid - 24 ELSE speech END AS sup FROM bb JOIN sm USING (user_id))"""  # fmt: skip


def _contrast(domain: str) -> str:
    s, c = f"s{domain}", f"c{domain}"
    crest = "sp - sf AS scr, cp - cf AS ccr" if domain == "f" else "NULL::DOUBLE AS scr, NULL::DOUBLE AS ccr"
    mean = lambda x: f"{x} - (avg({x}) FILTER (sup) OVER l + avg({x}) FILTER (sup) OVER rt) / 2"
    return f"""(SELECT user_id, i, {mean(s)} AS sc, {mean(c)} AS cc, {crest} FROM su
 WINDOW l AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 4 PRECEDING), rt AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN 4 FOLLOWING AND 20 FOLLOWING)
 QUALIFY sup AND i >= 20 AND i + 20 < n AND count(*) FILTER (sup) OVER l >= 4 AND count(*) FILTER (sup) OVER rt >= 4)"""  # fmt: skip


SPIKES = PAIRED + f""", ct AS (SELECT 'frame' AS domain, * FROM {_contrast("f")} UNION ALL SELECT 'body', * FROM {_contrast("b")}),
 ad AS (SELECT domain, user_id, i, greatest(0, cc - max(sc) OVER w) AS up, greatest(0, min(sc) OVER w - cc) AS down FROM ct WINDOW w AS (PARTITION BY domain, user_id ORDER BY i RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
 ql AS (SELECT domain, user_id, 'up' AS direction, i, up AS a FROM ad WHERE up >= 1.5 UNION ALL SELECT domain, user_id, 'down', i, down FROM ad WHERE down >= 1.5),
 cl AS (SELECT *, sum(nw) OVER (PARTITION BY domain, user_id, direction ORDER BY i) AS c FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY domain, user_id, direction ORDER BY i) > 5 THEN 1 ELSE 0 END AS nw FROM ql)),
 ev AS (SELECT domain, user_id, direction, round(min(i) * 0.02, 6) AS start_sec, round((max(i) + 1) * 0.02, 6) AS end_sec, round((arg_max(i, (a, -i)) + 0.5) * 0.02, 6) AS center_sec, max(a) AS peak FROM cl GROUP BY domain, user_id, direction, c)"""  # fmt: skip


def sides(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((C("user_id") % 4).alias("series"), "event_id", "ts")
    d = runs.top_per_group(e, KEYS, [C("ts"), C("event_id")], 2**62, "n").select("series", (C("n") - 1).cast("long").alias("frame_idx"), "event_id")
    d = long_series(spark, sf_dir).select("series", "frame_idx", "db").join(d, ["series", "frame_idx"])
    k, late = C("event_id"), 0.8 * C("db") + C("event_id") % 7 * 0.3 + C("frame_idx") % 400 * 0.01
    source = d.select("series", "frame_idx", C("db").alias("frame_db"), (C("db") + 3 + k % 5).alias("peak_db"), (C("db") - 2 - k % 3).alias("body_db"))
    candidate = d.select("series", (C("frame_idx") + 2).alias("frame_idx"), late.alias("frame_db"), (late + 3 + k % 4).alias("peak_db"), (late - 2 - k % 2).alias("body_db"))
    lead = d.select("series").distinct().select("series", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("frame_idx"), F.lit(-90.0).alias("frame_db"), F.lit(-80.0).alias("peak_db"), F.lit(-95.0).alias("body_db"))
    return source, candidate.unionByName(lead)


def speech(d):
    return runs.finalize_mask(masks.percentile_mask(d, "series", "frame_db", 0.25, 6.0), KEYS, "active", 3, 8)


def paired(spark, sf_dir):
    """Aligned frames and lags; both sides and the frames are read by several of the jobs that follow, so they are written."""
    frames, lags = env.aligned(*(kept(d, "envelope") for d in sides(spark, sf_dir)), KEYS, MS, speech)
    return kept(frames, "frames"), lags


def loud(spark, sf_dir):
    frames, _ = paired(spark, sf_dir)
    return frames, kept(env.expressive(env.contrasts(frames, KEYS, MS, "frame"), KEYS, MS), "loud")


@query(PAIRED + """, ca AS (SELECT user_id, i + 2 AS j, cf FROM su UNION ALL SELECT DISTINCT user_id, k, -90 FROM su, (SELECT unnest([0, 1]) AS k)), lg AS (SELECT unnest(generate_series(-12, 12)) AS lag),
 pr AS (SELECT su.user_id, lag, ca.cf - sf AS d FROM su, lg, ca WHERE sup AND ca.user_id = su.user_id AND ca.j = su.i + lag), pm AS (SELECT *, median(d) OVER (PARTITION BY user_id, lag) AS m FROM pr),
 sc AS (SELECT user_id, lag, median(abs(d - m)) AS score FROM pm GROUP BY user_id, lag HAVING count(*) >= 20),
 li AS (SELECT user_id, list_prepend({'lag': 0::BIGINT, 'score': any_value(score) FILTER (lag = 0)}, list({'lag': lag::BIGINT, 'score': score} ORDER BY lag) FILTER (lag <> 0)) AS l, any_value(score) FILTER (lag = 0) AS z FROM sc GROUP BY user_id),
 be AS (SELECT user_id, z, list_reduce(l, lambda b, x: CASE WHEN x.score < b.score - 0.05 OR (abs(x.score - b.score) <= 1e-9 AND abs(x.lag) < abs(b.lag)) THEN x ELSE b END) AS b FROM li)
 SELECT user_id AS series, b.lag AS lag, round(greatest(0, z - b.score), 6) AS improvement FROM be""")  # fmt: skip
def envelope_alignment(spark, sf_dir):
    return paired(spark, sf_dir)[1].select("series", "lag", r("improvement").alias("improvement"))


def _spikes(spark, sf_dir):
    frames, _ = paired(spark, sf_dir)
    each = [env.spike_events(env.contrasts(frames, KEYS, MS, d), KEYS, MS).withColumn("domain", F.lit(d)) for d in ("frame", "body")]
    return each[0].unionByName(each[1])


@query(SPIKES + " SELECT user_id AS series, domain, direction, count(*)::BIGINT AS events, round(quantile_cont(peak, 0.95), 6) AS p95 FROM ev GROUP BY user_id, domain, direction")
def envelope_spikes(spark, sf_dir):
    """How many stretches of contrast the processing added or took, and how strong they are."""
    return _spikes(spark, sf_dir).groupBy("series", "domain", "direction").agg(F.count("*").alias("events"), r(linear(C("peak"), 0.95)).alias("p95"))


@query(SPIKES + " SELECT user_id AS series, domain, direction, start_sec, end_sec, center_sec, round(peak, 6) AS peak, row_number() OVER (PARTITION BY user_id, domain, direction ORDER BY peak DESC, start_sec)::INT AS rank FROM ev QUALIFY rank <= 5")
def envelope_top_spikes(spark, sf_dir):
    d = env.top_events(_spikes(spark, sf_dir), [*KEYS, "domain", "direction"], "peak")
    return d.select("series", "domain", "direction", "start_sec", "end_sec", "center_sec", r("peak").alias("peak"), "rank")


LOUD = PAIRED + f""", cf AS MATERIALIZED (SELECT * FROM {_contrast("f")}), th AS (SELECT user_id, greatest(2.5, coalesce(quantile_cont(sc, 0.9) FILTER (sc > 0), 2.5)) AS t, greatest(6, coalesce(quantile_cont(scr, 0.9), 6)) AS u FROM cf GROUP BY user_id),
 lo AS (SELECT cf.* FROM cf JOIN th USING (user_id) WHERE sc >= t OR (sc >= 1.25 AND scr >= u)),
 ex AS MATERIALIZED (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY i) AS event FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) <= 4 THEN 0 ELSE 1 END AS nw FROM lo))"""  # fmt: skip


@query(LOUD + """, nr AS (SELECT ex.user_id, ex.event, ex.i, ex.sc, ex.scr, max(k.cc) AS cc, arg_max(k.ccr, (k.cc, -k.i)) AS ccr FROM ex JOIN cf k ON k.user_id = ex.user_id AND k.i BETWEEN ex.i - 1 AND ex.i + 1 GROUP BY ALL),
 tp AS (SELECT user_id, event, min(i) AS a, max(i) AS b, arg_max({'i': i, 'sc': sc, 'scr': scr, 'cc': cc, 'ccr': ccr}, (sc, -i)) AS t FROM nr GROUP BY user_id, event)
 SELECT user_id AS series, round(a * 0.02, 6) AS start_sec, round((b + 1) * 0.02, 6) AS end_sec, round((t.i + 0.5) * 0.02, 6) AS center_sec, round(t.sc, 6) AS s_contrast, round(t.cc, 6) AS c_contrast, round(greatest(0, t.cc) / t.sc, 6) AS ratio, round(t.ccr - t.scr, 6) AS crest_delta,
 greatest(0, t.cc) / t.sc < 0.55 OR t.cc - t.sc <= -2 AS flattened FROM tp WHERE t.sc > 0""")  # fmt: skip
def envelope_retention(spark, sf_dir):
    """What is left of each expressive event of the source."""
    d = env.retention_events(loud(spark, sf_dir)[1], KEYS, MS)
    return d.select("series", "start_sec", "end_sec", "center_sec", *(r(c).alias(c) for c in ("s_contrast", "c_contrast", "ratio", "crest_delta")), "flattened")


@query(LOUD + """, bo AS (SELECT su.* FROM su LEFT JOIN ex ON ex.user_id = su.user_id AND ex.i = su.i WHERE sup AND ex.i IS NULL),
 st AS (SELECT user_id, count(*) AS n, quantile_cont(sb, 0.1) - median(sb) AS sl, quantile_cont(cb, 0.1) - median(cb) AS cl, quantile_cont(sb, 0.9) - quantile_cont(sb, 0.1) AS sw, quantile_cont(cb, 0.9) - quantile_cont(cb, 0.1) AS cw, median(cb - cf) - median(sb - sf) AS ba FROM bo GROUP BY user_id)
 SELECT user_id AS series, n::BIGINT AS body_frames, round(sl, 6) AS s_floor, round(cl, 6) AS c_floor, round(sw, 6) AS s_spread, round(cw, 6) AS c_spread, round(cl - sl, 6) AS floor_fill, round(cw - sw, 6) AS spread_delta, round(ba, 6) AS balance_delta FROM st WHERE n >= 20""")  # fmt: skip
def envelope_body(spark, sf_dir):
    d = env.body(*loud(spark, sf_dir), KEYS)
    return d.select("series", "body_frames", *(r(c).alias(c) for c in d.columns[2:]))


_WINDOWS = """, {0}ch AS (SELECT *, CASE WHEN lag({1}) OVER w IS NULL OR lag({1}) OVER w = {1} THEN 0 ELSE 1 END AS g FROM {2} WINDOW w AS (PARTITION BY user_id ORDER BY i)), {0}rn AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY i) AS run FROM {0}ch),
 {0}pl AS (SELECT *, i - min(i) OVER (PARTITION BY user_id, run) AS a, count(*) OVER (PARTITION BY user_id, run) AS len FROM {0}rn WHERE {1}),
 {0}ex AS (SELECT *, unnest(generate_series(greatest(0, ceil((a - 14) / 5.0)::BIGINT), least(a // 5, (len - 15) // 5))) AS k FROM {0}pl WHERE len >= 15),
 {0}wn AS MATERIALIZED (SELECT user_id, run, k, median(sb) FILTER (sup) AS s, median(cb) FILTER (sup) AS c, bool_or(loud) AS loud FROM {0}ex GROUP BY user_id, run, k HAVING count(*) FILTER (sup) >= 12)"""
_MARKED = LOUD + ", sl AS (SELECT su.*, ex.i IS NOT NULL AS loud FROM su LEFT JOIN ex ON ex.user_id = su.user_id AND ex.i = su.i), mi AS (SELECT user_id, median(sb) FILTER (sup) AS middle FROM su GROUP BY user_id HAVING count(*) FILTER (sup) >= 20)"


@query(_MARKED.replace("ex.i IS NOT NULL AS loud", "coalesce(ex.event % 8 = 0, false) AS loud") + _WINDOWS.format("a", "speech", "sl") + """, ok AS (SELECT awn.* FROM awn JOIN mi USING (user_id) WHERE NOT loud AND s >= middle - 18),
 rs AS (SELECT user_id, run, quantile_cont(s, 0.9) - quantile_cont(s, 0.1) AS sw, quantile_cont(c, 0.9) - quantile_cont(c, 0.1) AS cw FROM ok GROUP BY user_id, run HAVING count(*) >= 5)
 SELECT d.user_id AS series, count(run)::BIGINT AS runs, round(median(sw), 6) AS s_spread, round(median(cw), 6) AS c_spread, round(median(cw - sw), 6) AS spread_delta, round(quantile_cont(cw - sw, 0.9), 6) AS spread_delta_p90, count(*) FILTER (cw - sw > 0.5)::BIGINT AS worsened FROM (SELECT DISTINCT user_id FROM su) d LEFT JOIN rs ON rs.user_id = d.user_id GROUP BY d.user_id""")  # fmt: skip
def envelope_run_spreads(spark, sf_dir):
    """Spread of window medians within runs of speech, before and after; one expressive event in eight counts."""
    delta, (frames, events) = C("c_spread") - C("s_spread"), loud(spark, sf_dir)
    d = env.run_spreads(frames, events.withColumn("event", F.when(C("event") % 8 == 0, C("event"))), KEYS, MS)
    d = frames.select("series").distinct().join(d, "series", "left").groupBy("series")
    return d.agg(F.count("run_id").alias("runs"), *(r(F.median(c)).alias(c) for c in ("s_spread", "c_spread")), r(F.median(delta)).alias("spread_delta"), r(linear(delta, 0.9)).alias("spread_delta_p90"), F.count_if(delta > env.WORSE_DB).alias("worsened"))


@query(_MARKED + ", sh AS (SELECT sl.*, speech AND sup AND sb >= middle - 24 AS held FROM sl JOIN mi USING (user_id))" + _WINDOWS.format("b", "held", "sh") + """, nn AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY k) AS j, count(*) OVER (PARTITION BY user_id, run) AS n FROM bwn),
 ee AS (SELECT *, greatest(1, floor(n * 0.2::DOUBLE + 0.5)) AS e FROM nn), ar AS (SELECT user_id, run, quantile_cont(s, 0.9) - quantile_cont(s, 0.1) AS ssp, quantile_cont(c, 0.9) - quantile_cont(c, 0.1) AS csp, max(s) FILTER (j > e AND j <= n - e) AS spk, max(c) FILTER (j > e AND j <= n - e) AS cpk,
 median(s) FILTER (j <= e) AS shd, median(c) FILTER (j <= e) AS chd, median(s) FILTER (j > n - e) AS stl, median(c) FILTER (j > n - e) AS ctl FROM ee WHERE n >= 5 AND n > 2 * e GROUP BY user_id, run)
 SELECT d.user_id AS series, count(run)::BIGINT AS runs, round(median(ssp), 6) AS s_spread, round(median(csp), 6) AS c_spread, round(median(csp - ssp), 6) AS spread_delta, round(quantile_cont(csp - ssp, 0.9), 6) AS spread_delta_p90, round(median(spk - shd), 6) AS s_rise, round(median(cpk - chd), 6) AS c_rise,
 round(median(cpk - chd - spk + shd), 6) AS rise_delta, round(median(spk - stl), 6) AS s_fall, round(median(cpk - ctl), 6) AS c_fall, round(median(cpk - ctl - spk + stl), 6) AS fall_delta FROM (SELECT DISTINCT user_id FROM su) d LEFT JOIN ar ON ar.user_id = d.user_id GROUP BY d.user_id""")  # fmt: skip
def envelope_run_arcs(spark, sf_dir):
    """How runs of supported speech rise to their loudest inner window and fall from it, before and after."""
    frames, events = loud(spark, sf_dir)
    d = frames.select("series").distinct().join(env.run_arcs(frames, events, KEYS, MS), "series", "left").groupBy("series")
    cols = [F.count("run_id").alias("runs"), r(linear(C("c_spread") - C("s_spread"), 0.9)).alias("spread_delta_p90")]
    for m in ("spread", "rise", "fall"):
        cols += [*(r(F.median(f"{s}_{m}")).alias(f"{s}_{m}") for s in "sc"), r(F.median(C(f"c_{m}") - C(f"s_{m}"))).alias(f"{m}_delta")]
    return d.agg(*cols)


@query(PAIRED + """, se AS (SELECT user_id, i // 500 AS section, median(sf) AS s, median(cf) AS c, median(cf - sf) AS d, any_value(n) AS n FROM su WHERE speech GROUP BY user_id, i // 500 HAVING count(*) >= 5),
 so AS (SELECT *, (section * 500 + least(n, section * 500 + 500)) * 0.01 AS mid, row_number() OVER (PARTITION BY user_id ORDER BY section) AS k, count(*) OVER (PARTITION BY user_id) AS many FROM se),
 sp AS (SELECT a.user_id, (b.s - a.s) / ((b.mid - a.mid) / 60) AS s, (b.c - a.c) / ((b.mid - a.mid) / 60) AS c, (b.d - a.d) / ((b.mid - a.mid) / 60) AS d FROM so a JOIN so b ON a.user_id = b.user_id AND b.k - a.k BETWEEN CASE WHEN a.many >= 3 THEN 2 ELSE 1 END AND 6),
 sl AS (SELECT user_id, median(s) AS s, median(c) AS c, median(d) AS d, greatest(0, quantile_cont(d, 0.75)) AS up, least(0, quantile_cont(d, 0.25)) AS dn FROM sp GROUP BY user_id), sw AS (SELECT user_id, quantile_cont(d, 0.9) - quantile_cont(d, 0.1) AS w, count(*) AS n FROM se GROUP BY user_id)
 SELECT sw.user_id AS series, n::BIGINT AS sections, round(w, 6) AS section_spread, round(s, 6) AS s_slope, round(c, 6) AS c_slope, round(d, 6) AS slope, round(up, 6) AS rising, round(dn, 6) AS falling FROM sw LEFT JOIN sl USING (user_id)""")  # fmt: skip
def envelope_drift(spark, sf_dir):
    """Slopes over sections of ten seconds, of source, candidate and what lies between them."""
    d = env.drift(env.sections(paired(spark, sf_dir)[0], KEYS, MS), KEYS)
    return d.select("series", "sections", *(r(c).alias(c) for c in ("section_spread", "s_slope", "c_slope", "slope", "rising", "falling")))
