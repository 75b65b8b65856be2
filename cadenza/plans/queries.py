"""Registered queries of the ordered-signal operators on the test tables, each with the SQL it is held against.

Series are the users of `events`, frames their events in order of time; levels are 20 log10 of the value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc
from cadenza.operators import frames as fr
from cadenza.operators import greedy, intervals, joins, masks, runs, scoring, signals, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEY = ["user_id"]

#: Frames as the SQL sides see them.
FR = """WITH fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_id, ts, value,
 CASE WHEN value <= 0 THEN -120 ELSE 20 * log10(value) END AS db FROM events)"""
#: Runs of frames at or over the series' lower quartile plus 6 dB.
RUNS = (
    FR
    + """, fl AS (SELECT user_id, quantile_cont(db, 0.25) AS nf FROM fr GROUP BY user_id),
 ac AS (SELECT fr.*, fl.nf, db >= nf + 6 AS active FROM fr JOIN fl USING (user_id)),
 ch AS (SELECT *, CASE WHEN lag(active) OVER w IS NULL OR lag(active) OVER w = active THEN 0 ELSE 1 END AS chg FROM ac WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
 rn AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY frame_idx) AS run_id FROM ch)"""
)


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fr.indexed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), KEY, ["ts", "event_id"])
    return events.withColumn("db", sc.to_db(F.col("value")))


def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.percentile_mask(frames(spark, sf_dir), "user_id", "db", 0.25, 6.0)


def r(x: str | Column, digits: int = 6) -> Column:
    return F.round(x, digits)


def big(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


@query(RUNS + """ SELECT user_id, run_id::BIGINT AS run_id, min(frame_idx)::BIGINT AS start_frame, (max(frame_idx) + 1)::BIGINT AS end_frame, count(*)::BIGINT AS frames,
 round(median(db), 6) AS median_db, round(quantile_cont(db, 0.1), 6) AS p10_db, round(quantile_cont(db, 0.9), 6) AS p90_db FROM rn WHERE active GROUP BY user_id, run_id""")  # fmt: skip
def speech_runs(spark, sf_dir):
    """Maximal runs of active frames with robust levels: the flagship query."""
    stats = (r(F.median("db")).alias("median_db"), r(pct.linear(F.col("db"), 0.1)).alias("p10_db"), r(pct.linear(F.col("db"), 0.9)).alias("p90_db"))
    found = runs.runs(active(spark, sf_dir), KEY, "active", *stats).where("active")
    return found.select("user_id", big("run_id").alias("run_id"), "start_frame", "end_frame", "frames", "median_db", "p10_db", "p90_db")


@query(FR + """ SELECT user_id, frame_idx::BIGINT AS frame_idx, round(db, 6) AS db, round(pow(10, db / 20), 6) AS linear, round(greatest(-60, least(-10, db - 60)), 6) AS clamped,
 round(CASE WHEN t <= 0 THEN 0 WHEN t >= 1 THEN 1 ELSE t * t * (3 - 2 * t) END, 6) AS ramp, floor(db + 0.5)::BIGINT AS half_up,
 round(CASE WHEN db - 30 < 0 THEN -12 * tanh((30 - db) / 12) ELSE db - 30 END, 6) AS soft FROM (SELECT *, (db - 10) / 30 AS t FROM fr)""")  # fmt: skip
def frame_levels(spark, sf_dir):
    d = F.col("db")
    return frames(spark, sf_dir).select(
        "user_id", "frame_idx", r("db").alias("db"), r(sc.db_to_linear(d)).alias("linear"), r(sc.clamp(d - 60, -60.0, -10.0)).alias("clamped"),
        r(sc.smooth_ramp(d, 10.0, 40.0)).alias("ramp"), big(sc.half_up(d)).alias("half_up"), r(sc.soft_limit_negative(d - 30, 12.0)).alias("soft"),
    )


@query("SELECT user_id, event_type, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.9), 6) AS p90, count(*)::BIGINT AS n FROM events GROUP BY user_id, event_type")
def percentile_family(spark, sf_dir):
    v = F.col("value")
    cols = [r(pct.linear(v, p)).alias(f"p{round(100 * p)}") for p in (0.1, 0.25, 0.5, 0.75, 0.9)]
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(*cols, F.count("*").alias("n"))


@query("SELECT user_id, round(l[floor(0.2::DOUBLE * (len(l) - 1) + 0.5)::INT + 1], 6) AS near20, round(l[floor(0.7::DOUBLE * (len(l) - 1) + 0.5)::INT + 1], 6) AS near70, round(l[(len(l) + 1) // 2], 6) AS lower_median FROM (SELECT user_id, list_sort(list(value)) AS l FROM events GROUP BY user_id)")
def nearest_rank_percentile(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(r(pct.nearest_rank(v, 0.2)).alias("near20"), r(pct.nearest_rank(v, 0.7)).alias("near70"), r(pct.lower_median(v)).alias("lower_median"))


def _weighted(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", (1 + (F.col("event_id") % 5) * 0.5).alias("weight"))


@query("""WITH c AS (SELECT user_id, value, sum(w) OVER (PARTITION BY user_id ORDER BY value) AS cw, sum(w) OVER (PARTITION BY user_id) AS tw FROM (SELECT *, 1 + (event_id % 5) * 0.5 AS w FROM events))
 SELECT user_id, round(min(CASE WHEN cw >= tw * 0.6 THEN value END), 6) AS p60 FROM c GROUP BY user_id""")  # fmt: skip
def weighted_step_percentile(spark, sf_dir):
    return pct.weighted_step(_weighted(spark, sf_dir), KEY, "value", "weight", 0.6, "p60").withColumn("p60", r("p60"))


@query("""WITH c AS (SELECT user_id, value, event_id, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY user_id) AS pos, row_number() OVER o AS n FROM (SELECT *, 1 + (event_id % 5) * 0.5 AS w FROM events)
 WINDOW o AS (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING)),
 d AS (SELECT *, lag(value) OVER o AS pv, lag(pos) OVER o AS pp FROM c WINDOW o AS (PARTITION BY user_id ORDER BY n)),
 e AS (SELECT user_id, n, pos, value, CASE WHEN n = 1 THEN value ELSE pv * (1 - least(1, greatest(0, (0.5 - pp) / (pos - pp)))) + value * least(1, greatest(0, (0.5 - pp) / (pos - pp))) END AS here FROM d)
 SELECT user_id, round(coalesce(min_by(here, n) FILTER (pos >= 0.5), max(value)), 6) AS anchor FROM e GROUP BY user_id""")  # fmt: skip
def weighted_midpoint_quantile(spark, sf_dir):
    return pct.weighted_midpoint(_weighted(spark, sf_dir), KEY, "value", "weight", 0.5, "anchor", "event_id").withColumn("anchor", r("anchor"))


@query("""WITH m AS (SELECT user_id, value, median(value) OVER (PARTITION BY user_id) AS md FROM events), d AS (SELECT *, abs(value - md) AS ad FROM m),
 k AS (SELECT *, median(ad) OVER (PARTITION BY user_id) AS mad FROM d) SELECT user_id, round(median(value) FILTER (mad = 0 OR ad / (1.4826 * mad) <= 2.8), 6) AS robust FROM k GROUP BY user_id""")  # fmt: skip
def mad_filtered_median(spark, sf_dir):
    return pct.mad_filtered_median(table(spark, sf_dir, "events"), KEY, "value", "robust").withColumn("robust", r("robust"))


@query(FR + " SELECT user_id, frame_idx::BIGINT AS frame_idx, round(avg(db) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM fr")
def moving_mean(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "frame_idx", r(windows.moving_mean("db", KEY, 2)).alias("smooth"))


@query(FR + " SELECT user_id, frame_idx::BIGINT AS frame_idx, round(db - coalesce((sum(db) OVER w - db) / nullif(count(*) OVER w - 1, 0), db), 6) AS contrast FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def neighbor_mean_contrast(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "frame_idx", r(F.col("db") - windows.neighbour_mean("db", KEY, 3)).alias("contrast"))


@query(FR + """ SELECT user_id, frame_idx::BIGINT AS frame_idx, CASE WHEN count(*) OVER a >= 4 AND count(*) OVER b >= 4 THEN round(db - (avg(db) OVER a + avg(db) OVER b) / 2, 6) END AS contrast FROM fr
 WINDOW a AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 20 PRECEDING AND 4 PRECEDING), b AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 4 FOLLOWING AND 20 FOLLOWING)""")  # fmt: skip
def shoulder_contrast(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "frame_idx", r(windows.shoulder_contrast("db", KEY, 4, 20, 4)).alias("contrast"))


@query(RUNS + """, d AS (SELECT user_id, frame_idx, last_value(CASE WHEN active THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
 first_value(CASE WHEN active THEN frame_idx END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM ac)
 SELECT user_id, frame_idx::BIGINT AS frame_idx, least(frame_idx - b, a - frame_idx)::BIGINT AS distance FROM d""")  # fmt: skip
def activity_distance(spark, sf_dir):
    return active(spark, sf_dir).select("user_id", "frame_idx", big(windows.active_distance(F.col("active"), KEY)).alias("distance"))


_MASK = RUNS + """, s AS (SELECT *, count(*) OVER (PARTITION BY user_id, run_id) AS len FROM rn), a1 AS (SELECT user_id, frame_idx, db, active AND len >= 3 AS act FROM s),
 c1 AS (SELECT *, CASE WHEN lag(act) OVER w IS NULL OR lag(act) OVER w = act THEN 0 ELSE 1 END AS chg FROM a1 WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
 r1 AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY frame_idx) AS rid FROM c1),
 l1 AS (SELECT *, count(*) OVER (PARTITION BY user_id, rid) AS len, max(rid) OVER (PARTITION BY user_id) AS lastr FROM r1),
 mk AS (SELECT user_id, frame_idx, db, act OR (rid > 0 AND rid < lastr AND len <= 2) AS active FROM l1)"""  # fmt: skip


def finalized(spark, sf_dir) -> DataFrame:
    return runs.finalize_mask(active(spark, sf_dir), KEY, "active", 3, 2)


@query(_MASK + " SELECT user_id, frame_idx::BIGINT AS frame_idx, active FROM mk")
def bridge_gaps(spark, sf_dir):
    return finalized(spark, sf_dir).select("user_id", "frame_idx", "active")


@query(RUNS + """, p AS (SELECT user_id, frame_idx, db, CASE WHEN frame_idx - lag(frame_idx) OVER w > 3 THEN 1 ELSE 0 END AS nw FROM ac WHERE active WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
 c AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY frame_idx) AS cid FROM p),
 g AS (SELECT user_id, cid, min(frame_idx) AS first, max(frame_idx) AS last, count(*) AS members, max(db) AS peak FROM c GROUP BY user_id, cid)
 SELECT user_id, first::BIGINT AS first, last::BIGINT AS last, members::BIGINT AS members, round(peak, 6) AS peak, n::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY members DESC, first) AS n FROM g) WHERE n <= 5""")  # fmt: skip
def gap_clusters_topk(spark, sf_dir):
    clusters = runs.gap_clusters(active(spark, sf_dir).where("active"), KEY, "frame_idx", 3, F.max("db").alias("peak"))
    best = runs.top_per_group(clusters, KEY, [F.desc("members"), F.col("first")], 5)
    return best.select("user_id", "first", "last", "members", r("peak").alias("peak"), big("rank").alias("rank"))


def spans(spark, sf_dir) -> DataFrame:
    """One interval per event, in seconds: it starts with the event and lasts as long as the value says."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", at.alias("s_start"), (at + F.col("value") * 20).alias("s_end"))


SPANS = "WITH sp AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS s_start, epoch_us(ts) / 1e6 + value * 20 AS s_end FROM events)"
MERGED = SPANS + """, n AS (SELECT *, CASE WHEN s_start > max(s_end) OVER (PARTITION BY user_id ORDER BY s_start, s_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60 THEN 1 ELSE 0 END AS nw FROM sp),
 g AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY s_start, s_end ROWS UNBOUNDED PRECEDING) AS id FROM n), mg AS (SELECT user_id, min(s_start) AS s_start, max(s_end) AS s_end FROM g GROUP BY user_id, id)"""


@query(MERGED + " SELECT user_id, round(s_start, 3) AS s_start, round(s_end, 3) AS s_end FROM mg")
def interval_merge(spark, sf_dir):
    merged = intervals.merge(spans(spark, sf_dir), KEY, "s_start", "s_end", 60.0)
    return merged.select("user_id", r("s_start", 3).alias("s_start"), r("s_end", 3).alias("s_end"))


@query(MERGED + """, b AS (SELECT user_id, min(s_start) - 100 AS low, max(s_end) + 100 AS high FROM sp GROUP BY user_id),
 p AS (SELECT user_id, s_start AS a, s_end AS e FROM mg UNION ALL SELECT user_id, high, high FROM b),
 q AS (SELECT user_id, a, max(e) OVER (PARTITION BY user_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM p)
 SELECT user_id, round(greatest(coalesce(f, low), low), 3) AS s_start, round(least(a, high), 3) AS s_end FROM q JOIN b USING (user_id) WHERE least(a, high) - greatest(coalesce(f, low), low) >= 30""")  # fmt: skip
def interval_complement(spark, sf_dir):
    every = spans(spark, sf_dir)
    bounds = every.groupBy("user_id").agg((F.min("s_start") - 100).alias("low"), (F.max("s_end") + 100).alias("high"))
    free = intervals.complement(intervals.merge(every, KEY, "s_start", "s_end", 60.0), bounds, KEY, "s_start", "s_end", 30.0)
    return free.select("user_id", r("s_start", 3).alias("s_start"), r("s_end", 3).alias("s_end"))


@query(MERGED + """, wn AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 - 1800 AS ws, epoch_us(ts) / 1e6 + 1800 AS we FROM events)
 SELECT wn.user_id, wn.event_id, round(coalesce(sum(greatest(0, least(we, s_end) - greatest(ws, s_start))), 0) / 3600, 6) AS occupancy FROM wn LEFT JOIN mg ON wn.user_id = mg.user_id AND s_start < we AND s_end > ws GROUP BY wn.user_id, wn.event_id""")  # fmt: skip
def occupancy_overlap_join(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    wins = table(spark, sf_dir, "events").select("user_id", "event_id", (at - 1800).alias("w_start"), (at + 1800).alias("w_end"))
    merged = intervals.merge(spans(spark, sf_dir), KEY, "s_start", "s_end", 60.0)
    out = intervals.occupancy(wins, merged, KEY, "event_id", 3600.0)
    return out.select("user_id", "event_id", r("occupancy").alias("occupancy"))


SECTIONS = FR + ", se AS (SELECT user_id, frame_idx // 10 AS section, median(db) AS level, count(*) AS frames FROM fr GROUP BY user_id, frame_idx // 10 HAVING count(*) >= 5)"


def sections(spark, sf_dir) -> DataFrame:
    return windows.tumbling(frames(spark, sf_dir), KEY, 10).groupBy("user_id", "section").agg(F.median("db").alias("level"), F.count("*").alias("frames")).where("frames >= 5")


@query(SECTIONS + " SELECT user_id, section::BIGINT AS section, round(level, 6) AS level, frames::BIGINT AS frames FROM se")
def tumbling_sections(spark, sf_dir):
    return sections(spark, sf_dir).select("user_id", "section", r("level").alias("level"), "frames")


@query(SECTIONS + """, n AS (SELECT user_id, count(*) AS n FROM fr GROUP BY user_id), o AS (SELECT se.*, row_number() OVER (PARTITION BY se.user_id ORDER BY section) AS k, count(*) OVER (PARTITION BY se.user_id) AS many,
 (section * 10 + least(n, section * 10 + 10)) / 2.0 AS mid FROM se JOIN n USING (user_id))
 SELECT a.user_id, round(median((b.level - a.level) / ((b.mid - a.mid) / 60)), 6) AS slope, count(*)::BIGINT AS pairs FROM o a JOIN o b ON a.user_id = b.user_id AND b.k - a.k BETWEEN CASE WHEN a.many >= 3 THEN 2 ELSE 1 END AND 6 GROUP BY a.user_id""")  # fmt: skip
def theil_sen_drift(spark, sf_dir):
    """Median slope a minute of section pairs two to six apart (one apart where there are two sections), at a frame a second."""
    w = Window.partitionBy("user_id")
    ends = frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    s = sections(spark, sf_dir).join(ends, "user_id")
    mid = (F.col("section") * 10 + F.least("n", F.col("section") * 10 + 10)) / 2
    s = s.select("user_id", F.row_number().over(w.orderBy("section")).alias("k"), F.count("*").over(w).alias("many"), "level", mid.alias("mid"))
    pairs = joins.lagged_pairs(s, s.select("user_id", "k", F.col("level").alias("later"), F.col("mid").alias("later_mid")), KEY, range(1, 7), "k")
    pairs = pairs.where((F.col("lag") >= 2) | (F.col("many") < 3))
    slope = (F.col("later") - F.col("level")) / ((F.col("later_mid") - F.col("mid")) / 60)
    return pairs.groupBy("user_id").agg(r(F.median(slope)).alias("slope"), F.count("*").alias("pairs"))


@query(FR + """, w AS (SELECT user_id, unnest(generate_series(greatest(0, ceil((frame_idx - 30 + 1) / 10.0)::BIGINT), frame_idx // 10)) AS win, db FROM fr), m AS (SELECT user_id, win, median(db) AS md FROM w GROUP BY user_id, win)
 SELECT user_id, round(quantile_cont(md, 0.9) - quantile_cont(md, 0.1), 6) AS spread, count(*)::BIGINT AS windows FROM m GROUP BY user_id""")  # fmt: skip
def sliding_run_spread(spark, sf_dir):
    s = windows.sliding(frames(spark, sf_dir), KEY, 30, 10).groupBy("user_id", "window").agg(F.median("db").alias("m"))
    return s.groupBy("user_id").agg(r(pct.linear(F.col("m"), 0.9) - pct.linear(F.col("m"), 0.1)).alias("spread"), F.count("*").alias("windows"))


_BODIES = _MASK + """, c2 AS (SELECT *, CASE WHEN lag(active) OVER w IS NULL OR lag(active) OVER w = active THEN 0 ELSE 1 END AS chg FROM mk WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)),
 r2 AS (SELECT *, sum(chg) OVER (PARTITION BY user_id ORDER BY frame_idx) AS rid FROM c2), rr AS (SELECT user_id, rid, min(frame_idx) AS s, max(frame_idx) + 1 AS e, avg(db) AS body, min(db) AS low FROM r2 WHERE active GROUP BY user_id, rid)"""


def bodies(spark, sf_dir) -> DataFrame:
    return runs.runs(finalized(spark, sf_dir), KEY, "active", F.avg("db").alias("body"), F.min("db").alias("low")).where("active")
