"""Registered queries of per-file decisions and per-run shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions.scalar import unit
from cadenza.operators import assessment as az
from cadenza.operators import runs, windows
from cadenza.plans.queries import _BODIES, FR, KEY, bodies, finalized, frames, query, r, table
from cadenza.plans.relations import LINES, measured

C = F.col


def u(x: str) -> str:
    return f"least(1, greatest(0, {x}))"


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN -40 - p_size END AS nf, CASE WHEN p_partkey % 3 <> 0 THEN -p_retailprice / 25 END AS ns, CASE WHEN p_partkey % 4 = 0 THEN -38 - p_size / 5 END AS th,
 CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 100) / 100.0 END AS room, CASE WHEN p_partkey % 6 <> 0 THEN p_size / 50.0 END AS conf FROM part),
 q AS (SELECT *, greatest(coalesce(nf, -70), coalesce(ns, -90)) AS fl, coalesce(room, 0) * least(1, greatest(0.75, 0.75 + 0.25 * coalesce(conf, 0.25))) AS sr FROM p),
 s AS (SELECT *, coalesce(th, least(-26, greatest(-58, fl + 10.5))) AS sp, CASE WHEN nf IS NULL AND ns IS NULL THEN 0 WHEN fl > -52 THEN 2 WHEN fl > -62 THEN 1 ELSE 0 END AS a, CASE WHEN sr < 0.33 THEN 0 WHEN sr < 0.58 THEN 1 ELSE 2 END AS rm FROM q),
 t AS (SELECT *, CASE WHEN a = 0 AND sp > -44 THEN 1 ELSE a END AS b FROM s)
 SELECT p_partkey, ['low', 'medium', 'high'][CASE WHEN b = 1 AND sp > -40 THEN 2 ELSE b END + 1] AS noise, ['low', 'medium', 'high'][CASE WHEN coalesce(conf, 0.25) < 0.35 THEN greatest(0, rm - 1) ELSE rm END + 1] AS room FROM t""")  # fmt: skip
def risk_levels(spark, sf_dir):
    k = C("p_partkey")
    d = table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 5 != 0, -40.0 - C("p_size")).alias("nf"), F.when(k % 3 != 0, -C("p_retailprice") / 25).alias("ns"), F.when(k % 4 == 0, -38 - C("p_size") / 5).alias("th"),
        F.when(k % 7 != 0, (k % 100) / 100.0).alias("room"), F.when(k % 6 != 0, C("p_size") / 50.0).alias("conf"),
    )
    return d.select("p_partkey", az.noise_risk(C("nf"), C("ns"), C("th")).alias("noise"), az.room_risk(C("room"), C("conf")).alias("room"))


_ZERO = {c: f"coalesce({c}, 0)" for c in ("onset", "swing", "pause", "compression", "echo")}
_WEIGHT = u(f"{u('instability')} - least(0.85, greatest(0, 0.5 * sag + 0.35 * {_ZERO['echo']})) - least(0.45, greatest(0, 0.45 * {_ZERO['pause']})) - least(0.35, greatest(0, 0.35 * {_ZERO['compression']}))")


@query(f"""{LINES}, w AS (SELECT *, {_WEIGHT} AS weight FROM li) SELECT l_orderkey, l_linenumber, round({u(f"0.24 * instability + 0.22 * {_ZERO['swing']} + 0.22 * jump + 0.14 * {_ZERO['onset']} + 0.10 * sag + 0.08 * end_fade")}, 6) AS continuity,
 round(least(0.82, greatest(0, 0.48 * {u('(jump * 2 - 9 + 9) / 7')} + 0.4 * {u('(instability * 14 - 5.5) / 7')})), 6) AS protection, round({u(f"0.72 * {u('(instability * 14 - 5.5) / 7')} + greatest(0, end_fade * 4 - 2) / 8")}, 6) AS leveling,
 round(weight, 6) AS weight, CASE WHEN round(weight, 9) < 0.2 THEN 0 WHEN round(weight, 9) >= 0.75 THEN 3 WHEN round(weight, 9) >= 0.45 THEN 2 ELSE 1 END AS repeats FROM w""")  # fmt: skip
def adaptive_decisions(spark, sf_dir):
    d = measured(spark, sf_dir)
    zero = lambda c: F.coalesce(C(c), F.lit(0.0))
    protection, need = az.leveling(C("jump") * 2 - 9, C("instability") * 14, C("end_fade") * 4 - 2)
    weight = az.reference_weight(C("instability"), C("sag"), C("echo"), C("pause"), C("compression"))
    return d.select(
        "l_orderkey", "l_linenumber", r(az.line_continuity(C("instability"), zero("swing"), C("jump"), zero("onset"), C("sag"), C("end_fade"))).alias("continuity"),
        r(protection).alias("protection"), r(need).alias("leveling"), r(weight).alias("weight"), az.reference_repeats(F.round(weight, 9)).alias("repeats"),
    )


@query(_BODIES + """, o AS (SELECT user_id, body, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY body) AS i FROM rr), t AS (SELECT *, CASE WHEN n >= 7 THEN greatest(1, floor(n * 0.15::DOUBLE)) ELSE 0 END AS trim FROM o)
 SELECT user_id, round(least(33, greatest(27, 0.6 * avg(body) + 0.4 * 30)), 6) AS target FROM t WHERE i > trim AND i <= greatest(trim + 1, n - trim) GROUP BY user_id""")  # fmt: skip
def planner_target(spark, sf_dir):
    """A target level from the trimmed mean of the runs' levels, blended with a fixed one."""
    return az.trimmed_target(bodies(spark, sf_dir), KEY, "body", 30.0, 0.6, "target").withColumn("target", r("target"))


@query(_BODIES + f""", f AS (SELECT r2.user_id, r2.rid, db, frame_idx - s AS a, e - s AS len FROM r2 JOIN rr ON r2.user_id = rr.user_id AND r2.rid = rr.rid), g AS (SELECT *, floor(a * 3 / len) AS th FROM f)
 SELECT user_id, rid::BIGINT AS run_id, count(*)::BIGINT AS frames, round(coalesce({u("((avg(db) FILTER (th = 0) + avg(db) FILTER (th = 2)) / 2 - avg(db) FILTER (th = 1) - 1.8) / 4.2")}, 0), 6) AS sag,
 round(coalesce({u("(avg(db) FILTER (a < 2) - avg(db) FILTER (a >= 2) - 2.5) / 4.5")}, 0), 6) AS onset FROM g GROUP BY user_id, rid HAVING count(*) >= 3""")  # fmt: skip
def run_shapes(spark, sf_dir):
    """Sag and onset of each run of at least three frames."""
    d = runs.with_run_id(finalized(spark, sf_dir), KEY, "active").where("active")
    w = Window.partitionBy("user_id", "run_id")
    d = d.withColumn("s", F.min("frame_idx").over(w)).withColumn("e", F.max("frame_idx").over(w) + 1)
    shapes = az.run_shape(d, [*KEY, "run_id"], "db", "s", "e").where("frames >= 3")
    return shapes.select("user_id", C("run_id").cast("long").alias("run_id"), "frames", r("sag").alias("sag"), r("onset").alias("onset"))


_PAIR = FR + ", p AS (SELECT user_id, frame_idx, db - 60 AS src, CASE WHEN event_id % 9 = 0 THEN db - 110 ELSE db - 62 END AS ren FROM fr)"


@query(_PAIR + """, m AS (SELECT *, quantile_cont(ren, 0.5) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS md FROM p),
 b AS (SELECT user_id, frame_idx FROM m WHERE (ren <= -68 AND src >= -50) OR (ren - src <= -24 AND ren <= -58 AND ren <= md - 18) OR (src >= -38 AND ren <= -54)),
 g AS (SELECT *, sum(CASE WHEN frame_idx - pr > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY frame_idx) AS cid FROM (SELECT *, lag(frame_idx) OVER (PARTITION BY user_id ORDER BY frame_idx) AS pr FROM b)),
 c AS (SELECT user_id, max(frame_idx) - min(frame_idx) + 1 AS len FROM g GROUP BY user_id, cid HAVING max(frame_idx) - min(frame_idx) + 1 >= 4),
 t AS (SELECT user_id, coalesce(sum(len), 0) AS bad, coalesce(max(len), 0) AS longest, count(len) AS clusters FROM (SELECT DISTINCT user_id FROM fr) LEFT JOIN c USING (user_id) GROUP BY user_id)
 SELECT user_id, bad::BIGINT AS bad_frames, clusters::BIGINT AS clusters, bad * 20 >= 350 OR longest * 20 >= 180 OR (clusters >= 3 AND bad * 20 >= 240) AS severe FROM t""")  # fmt: skip
def rendered_dropouts(spark, sf_dir):
    """Clusters of frames that a rendering lost (80 ms at least, gaps up to 60 ms bridged), by series, and whether they are severe."""
    d = frames(spark, sf_dir).select("user_id", "frame_idx", (C("db") - 60).alias("source"), F.when(C("event_id") % 9 == 0, C("db") - 110).otherwise(C("db") - 62).alias("rendered"))
    clusters = runs.gap_clusters(az.dropout_frames(d, KEY, "source", "rendered", 12).where("bad"), KEY, "frame_idx", 4)
    length = C("last") - C("first") + 1
    lost = clusters.where(length >= 4).groupBy("user_id").agg(F.sum(length).alias("bad_frames"), F.max(length).alias("longest"), F.count("*").alias("clusters"))
    every = d.select("user_id").distinct().join(lost, "user_id", "left").fillna(0)
    severe = az.dropout_severe(C("bad_frames") * 20 / 1000, C("longest") * 20 / 1000, C("clusters"))
    return every.select("user_id", "bad_frames", "clusters", severe.alias("severe"))


@query(FR + """, c AS (SELECT user_id, frame_idx, CASE WHEN count(*) OVER a >= 4 AND count(*) OVER b >= 4 THEN db - (avg(db) OVER a + avg(db) OVER b) / 2 END AS ct FROM fr
 WINDOW a AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 20 PRECEDING AND 4 PRECEDING), b AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 4 FOLLOWING AND 20 FOLLOWING)),
 t AS (SELECT user_id, greatest(2.5, coalesce(quantile_cont(ct, 0.9) FILTER (ct > 0), 2.5)) AS lim FROM c GROUP BY user_id)
 SELECT c.user_id, count(*)::BIGINT AS events, round(max(ct), 6) AS strongest FROM c JOIN t USING (user_id) WHERE ct >= lim GROUP BY c.user_id""")  # fmt: skip
def expressive_events(spark, sf_dir):
    """Frames that stand out of their surroundings more than nine tenths of the series' rising ones."""
    d = frames(spark, sf_dir).select("user_id", "frame_idx", windows.shoulder_contrast("db", KEY, 4, 20, 4).alias("ct"))
    limit = d.groupBy("user_id").agg(az.expressive_threshold(C("ct")).alias("limit"))
    return d.join(limit, "user_id").where("ct >= limit").groupBy("user_id").agg(F.count("*").alias("events"), r(F.max("ct")).alias("strongest"))


@query("""WITH v AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS best, ((o_orderkey * 7) % 100) / 130.0 AS second, CASE WHEN o_orderkey % 3 <> 0 THEN (o_custkey % 90) / 100.0 END AS gap, o_orderstatus = 'F' AS failed, o_orderpriority LIKE '1%' AS critical, o_custkey % 2 = 0 AS rival FROM orders)
 SELECT o_orderkey, round(least(1, greatest(0, (best - greatest(0, second)) * 3 + best * 0.35)), 6) AS alignment, round(least(0.97, greatest(0.3, 0.45 + 0.22 * coalesce(gap, 0.14) + 0.14 * failed::INT + 0.12 * critical::INT + 0.08 * rival::INT)), 6) AS review,
 round(least(1, greatest(0, 1.45 * best / 4 + 0.55 * second / 4 + 6 / 30.0)), 6) AS click FROM v""")  # fmt: skip
def confidences(spark, sf_dir):
    k = C("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_orderkey", ((k % 100) / 100.0).alias("best"), (((k * 7) % 100) / 130.0).alias("second"), F.when(k % 3 != 0, (C("o_custkey") % 90) / 100.0).alias("gap"), (C("o_orderstatus") == "F").alias("failed"), C("o_orderpriority").startswith("1").alias("critical"), (C("o_custkey") % 2 == 0).alias("rival"))
    return d.select("o_orderkey", r(az.alignment_confidence(C("best"), C("second"))).alias("alignment"), r(az.review_confidence(C("gap"), C("failed"), C("critical"), C("rival"))).alias("review"), r(az.click_score(C("best") / 4, C("second") / 4, F.lit(6.0))).alias("click"))


@query(_BODIES + " SELECT user_id, count(*)::BIGINT AS runs, round(stddev_pop(body), 6) AS sigma, round(max(body) - min(body), 6) AS spread FROM rr GROUP BY user_id")
def run_statistics(spark, sf_dir):
    return bodies(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("runs"), r(F.stddev_pop("body")).alias("sigma"), r(F.max("body") - F.min("body")).alias("spread"))


_NAMES = ["instability", "onset", "jump", "swing", "sag"]
_MISS = "(n / (1 + exp(-(" + " + ".join(f"d{k} * w{k}" for k in range(5)) + "))))"


@query(LINES.replace("WITH li", "WITH RECURSIVE li", 1) + f""", z AS (SELECT l_orderkey, l_linenumber, {", ".join(f"coalesce({x}, 0)::DOUBLE AS f{k}" for k, x in enumerate(_NAMES))} FROM li),
 pr AS MATERIALIZED (SELECT {", ".join(f"a.f{k} - b.f{k} AS d{k}" for k in range(5))}, count(*) AS n FROM z a JOIN z b ON a.l_orderkey = b.l_orderkey WHERE a.l_linenumber = 1 + a.l_orderkey % 2 AND b.l_linenumber <> 1 + b.l_orderkey % 2 GROUP BY 1, 2, 3, 4, 5),
 st AS (SELECT 0 AS step, {", ".join(f"0::DOUBLE AS w{k}" for k in range(5))} UNION ALL SELECT step + 1, {", ".join(f"w{k} - 0.08::DOUBLE * (sum({_MISS} * d{k}) / sum(n) + 0.0015::DOUBLE * w{k})" for k in range(5))} FROM st, pr WHERE step < 240 GROUP BY step, {", ".join(f"w{k}" for k in range(5))})
 SELECT l_orderkey, l_linenumber, round({" + ".join(f"f{k} * w{k}" for k in range(5))}, 6) AS score FROM z, st WHERE step = 240""")  # fmt: skip
def learned_ranking(spark, sf_dir):
    """Weights learned from each order's preferred line against all its others, applied to all lines."""
    from cadenza.operators import ranking

    pairs = ranking.preferred_over_others(measured(spark, sf_dir), "l_orderkey", C("l_linenumber") == 1 + C("l_orderkey") % 2, _NAMES)
    weights = ranking.fit(pairs, _NAMES)
    return measured(spark, sf_dir).select("l_orderkey", "l_linenumber", r(ranking.score(_NAMES, weights)).alias("score"))
