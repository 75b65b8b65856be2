"""Registered queries on batches: windows of twelve frames of each user's events, users as files, five groups of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators import batch_levels as bl
from cadenza.plans.queries import FR, frames, query, r

C = F.col


def windows(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("win", F.floor(C("frame_idx") / 6)).groupBy("user_id", "win").agg(F.avg("db").alias("speech_db"), F.percentile("db", F.lit(0.7)).alias("flat"), F.count("*").alias("frames"))
    d = d.withColumn("plateau_db", F.when(C("win") % 5 != 3, C("flat"))).withColumn("seconds", F.when(C("user_id") % 3 != 0, C("frames") * 0.3))
    return d.withColumn("frame_ms", F.when(C("user_id") % 6 != 0, 400.0))


def _ramp(x: str, start: float, full: float) -> str:
    t = f"least(1, greatest(0, ({x} - {start}) / {full - start}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _middle(source: str, by: str, value: str, weight: str, tie: str, out: str, where: str = "true") -> str:
    """CTE out_m (by, out): the weighted median through midpoints."""
    w = f"(PARTITION BY {by} ORDER BY {value}, {tie})"
    return f"""{out}_p AS (SELECT {by}, {value} AS v, (sum({weight}) OVER {w} - {weight} / 2.0::DOUBLE) / sum({weight}) OVER (PARTITION BY {by}) AS p, row_number() OVER {w} AS n FROM {source} WHERE {where}),
 {out}_l AS (SELECT {by}, list(v ORDER BY n) AS vs, list(p ORDER BY n) AS ps, len(list_filter(list(p), lambda x: x < 0.5)) AS k FROM {out}_p GROUP BY {by}),
 {out}_m AS (SELECT {by}, CASE WHEN k = 0 THEN vs[1] WHEN k = len(vs) THEN vs[k] ELSE vs[k] + (vs[k + 1] - vs[k]) * (0.5 - ps[k]) / (ps[k + 1] - ps[k]) END AS {out} FROM {out}_l)"""


FILES = FR + f""", wi AS (SELECT user_id, frame_idx // 6 AS win, avg(db) AS sp, quantile_cont(db, 0.7) AS fl, count(*) AS n FROM fr GROUP BY user_id, frame_idx // 6),
 ww AS (SELECT *, win % 5 <> 3 AS has, CASE WHEN user_id % 3 <> 0 THEN n * 0.3::DOUBLE WHEN user_id % 6 <> 0 THEN n * 0.4::DOUBLE END AS sec FROM wi), wt AS (SELECT *, CASE WHEN user_id % 6 <> 0 THEN sec ELSE 1.0::DOUBLE END AS wgt FROM ww),
 fs AS (SELECT user_id, median(sp) AS level, count(*) AS nw, CASE WHEN user_id % 6 <> 0 THEN coalesce(sum(sec) FILTER (has), 0) ELSE 0 END AS seconds, coalesce(sum(n) FILTER (has), 0) AS frames FROM wt GROUP BY user_id),
 {_middle("wt", "user_id", "fl", "wgt", "win", "pla", "has")},
 fe AS (SELECT fs.user_id, user_id % 5 AS grp, level, coalesce(pla, level) AS plateau, CASE WHEN seconds > 0 THEN {_ramp("seconds", 1, 15)} ELSE {_ramp("least(2, greatest(0.5, nw / 4.0::DOUBLE))", 0.5, 1)} END AS authority,
 least(2, greatest(0.5, CASE WHEN seconds > 0 THEN sqrt(seconds / 120) ELSE nw / 4.0::DOUBLE END)) AS vote, seconds, frames FROM fs LEFT JOIN pla_m USING (user_id))"""  # fmt: skip


def files(spark, sf_dir):
    return bl.file_levels(windows(spark, sf_dir), ["user_id"], "win")


_SHOWN = "round(level, 6) AS level, round(plateau, 6) AS plateau, round(authority, 6) AS authority, round(vote, 6) AS vote, round(seconds, 6) AS seconds, frames::BIGINT AS frames"


def _shown(d, key):
    return d.select(key, *(r(c).alias(c) for c in ("level", "plateau", "authority", "vote", "seconds")), C("frames").cast("long").alias("frames"))


@query(FILES + f" SELECT user_id, {_SHOWN}, round(level + authority * (plateau - level), 6) AS aligned FROM fe")
def file_speech_levels(spark, sf_dir):
    d = files(spark, sf_dir)
    aligned = d.select("user_id", r(bl.alignment_level(C("level"), C("plateau"), C("authority"))).alias("aligned"))
    return _shown(d, "user_id").join(aligned, "user_id")


@query(FILES + f""", gt AS (SELECT grp, bool_and(seconds > 0) AS ti, bool_and(seconds <= 0) AS un, bool_and(frames > 0) AS fd, sum(seconds) AS sm, median(plateau) AS mid, sum(frames) AS frames, avg(vote) AS vt, avg(authority) AS au FROM fe GROUP BY grp),
 gw AS (SELECT fe.*, CASE WHEN ti THEN fe.seconds WHEN un AND fd THEN fe.frames ELSE 1 END::DOUBLE AS wgt FROM fe JOIN gt USING (grp)),
 {_middle("gw", "grp", "level", "wgt", "user_id", "lev")}, {_middle("gw", "grp", "plateau", "wgt", "user_id", "pl2", "frames > 0")},
 ge AS (SELECT grp, lev AS level, coalesce(pl2, mid) AS plateau, CASE WHEN ti THEN {_ramp("sm", 1, 15)} WHEN un THEN au ELSE 0 END AS authority, least(2, greatest(0.5, CASE WHEN ti THEN sqrt(sm / 120) ELSE vt END)) AS vote, CASE WHEN ti THEN sm ELSE 0 END AS seconds, frames FROM gt JOIN lev_m USING (grp) LEFT JOIN pl2_m USING (grp))
 SELECT grp, {_SHOWN} FROM ge""")  # fmt: skip
def group_speech_levels(spark, sf_dir):
    return _shown(bl.group_levels(files(spark, sf_dir).withColumn("grp", C("user_id") % 5), ["grp"], "user_id"), "grp")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS s, o_custkey % 7 AS u FROM orders), m AS (SELECT *, CASE WHEN s > 720 THEN 15.0::DOUBLE ELSE 30.0::DOUBLE END AS z, CASE WHEN s > 720 THEN least(24, greatest(13, ceil(s / 60))) ELSE 6 END::BIGINT AS n FROM o)
 SELECT o_orderkey, CASE WHEN s <= 0 THEN 0 WHEN s <= 180 THEN 1 ELSE n END AS many, round(CASE WHEN s <= 180 THEN 0 ELSE (s - z) / (n - 1) END, 6) AS second, CASE WHEN s <= 180 AND s > 0 THEN u >= 1 ELSE u >= 4 END AS enough FROM m""")  # fmt: skip
def listening_windows(spark, sf_dir):
    from cadenza.plans.queries import table

    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (C("o_totalprice") / 100).alias("s")).withColumn("w", bl.even_windows(C("s")))
    second = sc.clamp(F.coalesce(F.get("w", F.lit(1))["start"], F.lit(0.0)), 0.0, 1e9)
    return d.select("o_orderkey", F.size("w").cast("long").alias("many"), r(second).alias("second"), bl.enough(C("w"), C("o_custkey") % 7, C("s")).alias("enough"))
