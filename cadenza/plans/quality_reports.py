"""Registered queries of the quality report on long series: all events of a quarter of the users, in order of time.

Frames are 10 ms. A frame is active from 6 dB over the series' lower quartile; short runs go and gaps up to 8 frames close.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc
from cadenza.operators import blocks
from cadenza.operators import quality_report as qr
from cadenza.plans.queries import _BODIES, query, r, table
from cadenza.plans.relations import LINES, measured
from cadenza.sources.tables import kept

C, MS = F.col, 10.0
KEYS = ["series"]
#: The runs rr (user_id, rid, s, e), their frames r2 and the mask mk of the long series, as SQL.
LONG = _BODIES.replace("(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER", "(SELECT user_id % 4 AS user_id, row_number() OVER (PARTITION BY user_id % 4 ORDER").replace("len <= 2", "len <= 8")
_SERIES = ", sr AS (SELECT DISTINCT user_id FROM fr)"


def _unit(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


def _trim(length: str) -> str:
    return f"CASE WHEN {length} < 55 THEN greatest(1, least(4, floor(({length}) * 0.1::DOUBLE))) ELSE greatest(6, least(18, floor(({length}) * 0.14::DOUBLE))) END"


_POWER = "10 * log10(avg(pow(10, db / 10)) + 1e-30)"


def long_levels(spark, sf_dir):
    """series, frame_idx, db, floor and target (the series' quartile and median), frames (how many).

    A series is as long as the table, so every step is dealt by blocks of it.
    """
    e = table(spark, sf_dir, "events").select((C("user_id") % 4).alias("series"), "event_id", "ts", "value")
    d = blocks.indexed(e.withColumn("db", sc.to_db(C("value"))), KEYS, ["ts", "event_id"]).select("series", "frame_idx", "db")
    d = kept(d, "levels")
    d = sc.with_facts(d.where("series IS NOT NULL"), pct.placed(d, KEYS, {"floor": ("db", 0.25), "target": ("db", 0.5)}), KEYS)
    return d.withColumnRenamed("__n", "frames")


def long_series(spark, sf_dir):
    """The same with active and run_id."""
    d = long_levels(spark, sf_dir).withColumn("active", C("db") >= C("floor") + 6.0)
    d = kept(blocks.finalize_mask(d, KEYS, "active", 3, 8, "frames"), "masked")
    return kept(blocks.with_run_id(d, KEYS, "active"), "series")


def placed(d):
    return qr.in_runs(d, KEYS, "active", "run_id")


@query(LONG + _SERIES + """, q AS (SELECT user_id, rid, s, e - s AS len, least(5, greatest(3, (e - s) // 18)) AS nb FROM rr WHERE e - s >= 80), bk AS (SELECT *, unnest(generate_series(0, nb - 1)) AS b FROM q),
 bm AS (SELECT bk.user_id, bk.rid, b, avg(db) AS m FROM bk JOIN fr ON fr.user_id = bk.user_id AND frame_idx >= s + (b * len) // nb AND frame_idx < s + ((b + 1) * len) // nb GROUP BY bk.user_id, bk.rid, b),
 l AS (SELECT user_id, rid, list(m ORDER BY b) AS ms FROM bm GROUP BY user_id, rid), d AS (SELECT *, list_filter(list_transform(generate_series(2, len(ms)), lambda i: ms[i] - ms[i - 1]), lambda x: abs(x) >= 0.65) AS st FROM l),
 t AS (SELECT user_id, list_max(ms) - list_min(ms) AS rg, len(list_filter(generate_series(2, len(st)), lambda i: st[i] * st[i - 1] < 0)) AS turns FROM d),"""
 + f" v AS (SELECT user_id, quantile_cont({_unit(_unit('(rg - 3) / 4.5') + ' * 0.62 + ' + _unit('(turns - 1) / 2.0') + ' * 0.38')}, 0.75) AS x FROM t GROUP BY user_id) SELECT sr.user_id AS series, round(coalesce(x, 0), 6) AS swing FROM sr LEFT JOIN v USING (user_id)")
def line_swing(spark, sf_dir):
    """Swing within runs of at least 80 frames: range of three to five parts, and how often strong steps turn."""
    d = long_series(spark, sf_dir)
    return d.select("series").distinct().join(qr.line_swing(placed(d), KEYS, "db"), "series", "left").select("series", r(F.coalesce("swing", F.lit(0.0))).alias("swing"))


_RUN_TRIM = _trim("e - s")


@query(LONG + _SERIES + f""", n AS (SELECT user_id, count(*) AS n FROM rr GROUP BY user_id), du AS (SELECT user_id, 100 * avg(CASE WHEN active THEN 1.0 ELSE 0.0 END) AS duty FROM mk GROUP BY user_id),
 b AS (SELECT rr.user_id, rid, s, e, avg(fr.db) AS mn, median(fr.db) AS md FROM rr JOIN fr ON fr.user_id = rr.user_id AND frame_idx >= s + {_RUN_TRIM} AND frame_idx < e - {_RUN_TRIM} WHERE e - s >= 55 GROUP BY rr.user_id, rid, s, e),
 j AS (SELECT b.user_id, duty < 6 OR n <= 8 AS sp, greatest(0, s - lag(e) OVER w) AS gap, abs(mn - lag(mn) OVER w) AS a, abs(md - lag(md) OVER w) AS c FROM b JOIN n USING (user_id) JOIN du USING (user_id) WINDOW w AS (PARTITION BY b.user_id ORDER BY s)),
 x AS (SELECT user_id, sp, gap * 10 AS ms, CASE WHEN sp THEN greatest(c, a * 0.8) ELSE a END AS jump FROM j WHERE gap >= CASE WHEN sp THEN 8 ELSE 12 END),
 y AS (SELECT user_id, sp, CASE WHEN sp THEN {_unit('(jump - 1.2) / 3.3')} * 0.9 + {_unit('(ms - 80) / 700.0')} * 0.1 ELSE {_unit('(jump - 1.8) / 4.2')} * 0.82 + {_unit('(ms - 120) / 900.0')} * 0.18 END AS sc FROM x),
 v AS (SELECT user_id, CASE WHEN bool_or(sp) THEN quantile_cont({_unit('sc')}, 0.8) ELSE quantile_cont({_unit('sc')}, 0.75) END AS x FROM y GROUP BY user_id)
 SELECT sr.user_id AS series, round(coalesce(x, 0), 6) AS jump FROM sr LEFT JOIN v USING (user_id)""")  # fmt: skip
def sentence_jump(spark, sf_dir):
    """Level jumps between consecutive runs' bodies, weighed with the pause between them; finer where speech is sparse."""
    d = long_series(spark, sf_dir)
    duty = d.groupBy("series").agg((100 * F.avg(C("active").cast("double"))).alias("duty"))
    jump = qr.sentence_jump(placed(d), KEYS, "db", MS, duty)
    return duty.join(jump, "series", "left").select("series", r(F.coalesce("jump", F.lit(0.0))).alias("jump"))


@query(LONG + _SERIES + f""", o AS (SELECT user_id, rid, s, e, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n, 250 - (sum(e - s) OVER w - (e - s)) AS rest FROM rr WINDOW w AS (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING)),
 h AS (SELECT *, least(e - s, rest) AS take FROM o WHERE n >= 2 AND k < least(3, greatest(1, n - 1)) AND rest > 0), en AS (SELECT user_id, max(s + take) AS ends FROM h GROUP BY user_id),
 hb AS (SELECT h.user_id, k, {_POWER} AS body FROM h JOIN fr ON fr.user_id = h.user_id AND frame_idx >= s + {_trim("take")} AND frame_idx < s + take - {_trim("take")} WHERE take >= 12 GROUP BY h.user_id, k),
 lb AS (SELECT o.user_id, k, {_POWER} AS body FROM o JOIN en ON o.user_id = en.user_id AND s >= ends JOIN fr ON fr.user_id = o.user_id AND frame_idx >= s + {_RUN_TRIM} AND frame_idx < e - {_RUN_TRIM} WHERE e - s >= 12 GROUP BY o.user_id, k),
 v AS (SELECT user_id, (SELECT median(body) FROM lb WHERE lb.user_id = sr.user_id) - (SELECT min(body) FROM hb WHERE hb.user_id = sr.user_id) AS x FROM sr)
 SELECT user_id AS series, round(coalesce(x, 0), 6) AS dip, round({_unit('(coalesce(x, 0) - 1) / 4')}, 6) AS risk FROM v""")  # fmt: skip
def cold_open_dip(spark, sf_dir):
    """How far the weakest run of the first 2.5 seconds of speech is under the median of the runs after them."""
    d = long_series(spark, sf_dir)
    d = d.select("series").distinct().join(qr.cold_open(placed(d), KEYS, "db", MS), "series", "left").fillna(0.0, ["cold_open"])
    return d.select("series", r("cold_open").alias("dip"), r(sc.unit((C("cold_open") - qr.DIP_FLOOR_DB) / qr.DIP_SPAN_DB)).alias("risk"))


@query(LONG + _SERIES + f""", t AS (SELECT rr.user_id, rid, {_POWER} AS tail FROM rr JOIN fr ON fr.user_id = rr.user_id AND frame_idx >= e - 15 AND frame_idx < e WHERE e - s >= 27 GROUP BY rr.user_id, rid),
 b AS (SELECT rr.user_id, rid, {_POWER} AS body FROM rr JOIN fr ON fr.user_id = rr.user_id AND frame_idx >= greatest(s, e - 60) AND frame_idx < e - 15 WHERE e - s >= 27 GROUP BY rr.user_id, rid),
 v AS (SELECT t.user_id, max(body - tail) AS x FROM t JOIN b ON t.user_id = b.user_id AND t.rid = b.rid GROUP BY t.user_id) SELECT sr.user_id AS series, round(greatest(0, coalesce(x, 0)), 6) AS end_dip FROM sr LEFT JOIN v USING (user_id)""")  # fmt: skip
def end_edge_dip(spark, sf_dir):
    """The most by which the last 150 ms of a run are under the 450 ms before them."""
    d = long_series(spark, sf_dir)
    d = d.select("series").distinct().join(qr.end_edge_dip(placed(d), KEYS, "db", MS), "series", "left")
    return d.select("series", r(F.coalesce("end_dip", F.lit(0.0))).alias("end_dip"))


@query(LONG + f" SELECT rr.user_id AS series, s::BIGINT AS start_frame, (e - s)::BIGINT AS frames, CASE WHEN e - s >= 12 THEN round(10 * log10(avg(pow(10, fr.db / 10)) FILTER (frame_idx >= s + {_RUN_TRIM} AND frame_idx < e - {_RUN_TRIM}) + 1e-30), 6) END AS body FROM rr JOIN fr ON fr.user_id = rr.user_id AND frame_idx >= s AND frame_idx < e GROUP BY rr.user_id, s, e")
def run_bodies(spark, sf_dir):
    """The level of each run's body without its edges."""
    d = qr.edge_trimmed_bodies(placed(long_series(spark, sf_dir)), KEYS, "db")
    return d.select("series", C("s").cast("long").alias("start_frame"), C("len").alias("frames"), r("body").alias("body"))


_COLUMNS = {"pause": "pause", "instability": "instability", "swing": "swing", "jump": "jump", "cold_open": "(l_partkey % 40) / 10.0", "onset": "onset", "breath": "breath", "sag": "sag", "end_fade": "end_fade", "compression": "compression", "click": "click", "echo": "echo", "clip": "clip"}


def _found(at: int) -> str:
    parts = []
    for metric, limit, *texts in qr.FINDINGS:
        over = f"coalesce({_COLUMNS[metric]}, 0) >= {limit}"
        if limit == qr.DIP_WARN_DB:
            over += f" AND coalesce({_COLUMNS[metric]}, 0) < {qr.DIP_FLAG_DB}"
        parts.append(f"CASE WHEN {over} THEN '{texts[at]}' END")
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), ' ')"


@query(LINES.replace(" FROM lineitem)", ", l_partkey FROM lineitem)") + f" SELECT l_orderkey, l_linenumber, coalesce(nullif({_found(0)}, ''), '{qr.QUIET[0]}') AS flags, coalesce(nullif({_found(1)}, ''), '{qr.QUIET[1]}') AS advice FROM li")
def quality_findings(spark, sf_dir):
    """Findings and advice of each measured line, in the report's order."""
    d = measured(spark, sf_dir, "l_partkey")
    flags, advice = qr.findings({m: F.expr(x) for m, x in _COLUMNS.items()})
    return d.select("l_orderkey", "l_linenumber", F.array_join(flags, " ").alias("flags"), F.array_join(advice, " ").alias("advice"))
