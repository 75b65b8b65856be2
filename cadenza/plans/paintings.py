"""Registered queries on corrections of gains: the long series of the quality report under a plan that follows their level."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators import blocks, painting
from cadenza.plans.quality_reports import KEYS, LONG, long_levels, long_series
from cadenza.plans.queries import query, r
from cadenza.sources.tables import kept

C = F.col
NEAR, LOW, HIGH = 10, -9.0, 12.0
#: Frames of speech pl (with run rid from s to e), with target tg, floor nf and plan g.
PLAN = LONG + f""", ta AS (SELECT user_id, median(db) AS tg, quantile_cont(db, 0.25) AS nfl FROM fr GROUP BY user_id),
 pg AS (SELECT fr.user_id, frame_idx AS i, db, tg, nfl, least({HIGH}, greatest({LOW}, tg - avg(db) OVER (PARTITION BY fr.user_id ORDER BY frame_idx ROWS BETWEEN {NEAR} PRECEDING AND {NEAR} FOLLOWING))) AS g FROM fr JOIN ta USING (user_id)),
 pl AS (SELECT pg.*, rid, s, e, i - s AS ix, e - s AS n FROM pg JOIN rr ON rr.user_id = pg.user_id AND i >= s AND i < e)"""  # fmt: skip


def planned(d, again: bool = True):
    """Frames with a plan that follows their level; kept where they are read again."""
    near = Window.partitionBy("series", "__block").orderBy("frame_idx").rowsBetween(-NEAR, NEAR)
    d = blocks.beside_blocks(d.drop("frames"), NEAR)
    d = blocks.of_blocks(d.withColumn("gain", sc.clamp(C("target") - F.avg("db").over(near), LOW, HIGH)))
    return kept(d, "planned") if again else d


def _shown(d):
    return d.where("active").select("series", "frame_idx", r("gain").alias("gain"))


@query(PLAN + """, sh AS (SELECT a.user_id, a.i, any_value(a.db) AS db, any_value(a.g) AS g, avg(b.db) FILTER (b.i < a.i) AS ls, avg(b.db) FILTER (b.i > a.i) AS rs, avg(b.db + b.g) FILTER (b.i < a.i) AS lo, avg(b.db + b.g) FILTER (b.i > a.i) AS ro
 FROM pl a LEFT JOIN pl b ON b.user_id = a.user_id AND b.rid = a.rid AND abs(b.i - a.i) BETWEEN 6 AND 14 AND a.i - 14 >= a.s AND a.i + 14 < a.e GROUP BY a.user_id, a.i)
 SELECT user_id AS series, i::BIGINT AS frame_idx, round(g + 0.7 * coalesce(CASE WHEN ls IS NOT NULL THEN greatest(0, least(least(lo, ro) - db - g, least(lo, ro) - db - g - (least(ls, rs) - db))) END, 0), 6) AS gain FROM sh""")  # fmt: skip
def valley_relaxation(spark, sf_dir):
    return _shown(painting.relax_valleys(planned(long_series(spark, sf_dir)), KEYS, "db", "gain", "active", run="run_id"))


def _soft(x: str, knee: float) -> str:
    return f"CASE WHEN ({x}) / {knee} > 40 THEN {x} WHEN ({x}) / {knee} < -40 THEN 0 ELSE {knee} * ln(1 + exp(least(40, ({x}) / {knee}))) END"


@query(PLAN + f""", cx AS (SELECT a.user_id, a.i, any_value(a.db) AS db, greatest(0, any_value(a.g)) AS up, least(0, any_value(a.g)) AS dn, any_value(a.tg) AS tg,
 10 * log10(sum(pow(cos(abs(b.i - a.i) / 13.0::DOUBLE * pi() / 2), 2) * pow(10, b.db / 10)) / sum(pow(cos(abs(b.i - a.i) / 13.0::DOUBLE * pi() / 2), 2)) + 1e-30) AS ar FROM pl a JOIN pl b ON b.user_id = a.user_id AND b.rid = a.rid AND abs(b.i - a.i) <= 12 GROUP BY a.user_id, a.i),
 ev AS (SELECT *, tg + 0.5 - (db + (ar - db) * 0.25) AS lack FROM cx), bu AS (SELECT *, up - ({_soft("lack", 0.35)}) AS over FROM ev)
 SELECT user_id AS series, i::BIGINT AS frame_idx, round(dn + greatest(0, up - ({_soft("over", 0.35)}) * pow(up, 4) / (pow(up, 4) + 1296)), 6) AS gain FROM bu""")  # fmt: skip
def event_authority(spark, sf_dir):
    return _shown(painting.limit_authority(planned(long_series(spark, sf_dir)), KEYS, "db", "gain", "active", C("target"), run="run_id"))


_POWER = "10 * log10(avg(pow(10, db / 10)){} + 1e-30)"
TRENDS = PLAN + f""", tw AS (SELECT *, greatest(1, least(10, n // 4)) AS tw FROM pl WHERE n >= 2), th AS (SELECT *, greatest(1, tw // 2) AS h, greatest(4, least(20, n // tw)) AS m, floor(n * 0.1::DOUBLE + 0.5) AS hc, floor(n * 0.9::DOUBLE + 0.5) AS tc FROM tw),
 en AS (SELECT user_id, rid, any_value(n) AS n, any_value(hc) AS hc, any_value(tc) AS tc, {_POWER.format(" FILTER (abs(ix - hc) <= h)")} AS hd, {_POWER.format(" FILTER (abs(ix - tc) <= h)")} AS td, avg(g) FILTER (abs(ix - hc) <= h) AS hg, avg(g) FILTER (abs(ix - tc) <= h) AS tgn FROM th GROUP BY user_id, rid),
 sp AS (SELECT user_id, rid, m, k, {_POWER.format("")} AS x FROM (SELECT *, unnest(generate_series(0, m - 1)) AS k FROM th) WHERE abs(ix - floor(k / (m - 1)::DOUBLE * (n - 1) + 0.5)) <= h GROUP BY user_id, rid, m, k),
 st AS (SELECT *, coalesce(x - lag(x) OVER (PARTITION BY user_id, rid ORDER BY k), 0) AS d, (k - 0.5) / (m - 1) <= 0.5 AS ea FROM sp),
 tr AS (SELECT user_id, rid, coalesce(sum(greatest(0, d)) FILTER (ea), 0) AS ue, coalesce(sum(greatest(0, d)) FILTER (NOT ea), 0) AS ul, coalesce(sum(greatest(0, -d)) FILTER (ea), 0) AS de, coalesce(sum(greatest(0, -d)) FILTER (NOT ea), 0) AS dl FROM st GROUP BY user_id, rid),
 tq1 AS (SELECT *, td > hd AS ris, greatest(0, ({_soft("abs(td - hd)", 0.18)}) - 0.18 * ln(2)) AS t, CASE WHEN td > hd THEN ue ELSE de END AS f1, CASE WHEN td > hd THEN ul ELSE dl END AS f2, CASE WHEN td > hd THEN hg - tgn ELSE tgn - hg END AS cur FROM en JOIN tr USING (user_id, rid)),
 tq2 AS (SELECT *, (f1 + f2) / (ue + ul + de + dl + 0.18) * least(1, greatest(0, 2 * least(f1, f2) / (f1 + f2 + 0.18))) AS sa, hc / greatest(1, n - 1) AS hp, tc / greatest(1, n - 1) AS tp FROM tq1),
 tq3 AS (SELECT *, least(t * (0.12 + 0.16 * (0.5 + 0.5 * tanh((t - 9) / 4))) * sa, t * 0.28) - cur AS lack, least(1, hp) AS h1, least(1, tp) AS t1 FROM tq2), tq4 AS (SELECT *, least(3.2, ({_soft("lack", 0.18)}) * sa) AS res FROM tq3),
 tq5 AS (SELECT user_id, rid, ris, CASE WHEN t > 0 AND res > 0 THEN least(3.2, res / greatest(0.1, t1 * t1 * (3 - 2 * t1) - h1 * h1 * (3 - 2 * h1))) END AS lift FROM tq4),
 fl2 AS (SELECT pl.*, ris, lift, ix / greatest(1, n - 1)::DOUBLE AS p FROM pl LEFT JOIN tq5 USING (user_id, rid)), f3 AS (SELECT *, p * p * (3 - 2 * p) AS sh FROM fl2)"""  # fmt: skip


@query(TRENDS + f" SELECT user_id AS series, i::BIGINT AS frame_idx, round(CASE WHEN lift IS NULL THEN g ELSE least({HIGH}, g + greatest(0, lift * CASE WHEN ris THEN 1 - sh ELSE sh END / (1 + exp(-(db - (nfl + 8)) / 4)))) END, 6) AS gain FROM f3")
def trend_balance(spark, sf_dir):
    return _shown(painting.balance_trends(planned(long_series(spark, sf_dir)), KEYS, "db", "gain", "active", "floor", HIGH, run="run_id"))


_SIDE = "abs(b.i - a.i) BETWEEN 10 AND 24"
_CENTRE = "abs(b.i - a.i) <= 2"


@query(PLAN + f""", q AS (SELECT user_id, rid, i, n, db, db + 3 * sin(i / 7.0::DOUBLE) AS bo, g FROM pl), cc AS (SELECT a.user_id, a.rid, a.i, avg(b.db) FILTER ({_CENTRE}) AS cs, avg(b.bo) FILTER ({_CENTRE}) AS cb,
 least(avg(b.db) FILTER ({_SIDE} AND b.i < a.i), avg(b.db) FILTER ({_SIDE} AND b.i > a.i)) AS ss, least(avg(b.bo) FILTER ({_SIDE} AND b.i < a.i), avg(b.bo) FILTER ({_SIDE} AND b.i > a.i)) AS sb
 FROM pl a JOIN q b ON b.user_id = a.user_id AND b.rid = a.rid AND abs(b.i - a.i) <= 24 AND a.i - 24 >= a.s AND a.i + 24 < a.e AND a.n > 48 GROUP BY a.user_id, a.rid, a.i),
 al AS (SELECT *, least(sb - cb, ss - cs) AS x FROM cc), cv AS (SELECT *, greatest(0, ({_soft("x", 0.5)}) - 0.5 * ln(2)) AS c FROM al), rp AS (SELECT *, least(1, greatest(0, (c - 0.75) / 5.25)) AS t FROM cv),
 rw AS (SELECT user_id, rid, sum(t * t * (3 - 2 * t)) AS w FROM rp GROUP BY user_id, rid), rq AS (SELECT q.user_id, q.rid, q.i, q.g, least(4, coalesce(c, 0) * 0.6) * coalesce(w / (w + n * 0.04), 0) AS l FROM q LEFT JOIN rp USING (user_id, rid, i) LEFT JOIN rw USING (user_id, rid))
 SELECT a.user_id AS series, a.i::BIGINT AS frame_idx, round(least({HIGH}, any_value(a.g) + max(b.l - 0.24 * abs(a.i - b.i))), 6) AS gain FROM rq a JOIN rq b ON b.user_id = a.user_id AND b.rid = a.rid AND abs(a.i - b.i) <= 20 GROUP BY a.user_id, a.i""")  # fmt: skip
def recurrent_valleys(spark, sf_dir):
    """The body's level is the series' own with a ripple, so that both must agree on a valley."""
    d = planned(long_series(spark, sf_dir)).withColumn("speech_body", C("db") + 3 * F.sin(C("frame_idx") / 7))
    return _shown(painting.recover_valleys(d, KEYS, "db", "speech_body", "gain", "active", HIGH, run="run_id"))


def _ramp(x: str) -> str:
    return f"(least(1, greatest(0, {x})) ** 2 * (3 - 2 * least(1, greatest(0, {x}))))"


def _over(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN greatest(0, ({_soft(x, 0.6)}) - 0.6 * ln(2)) ELSE 0 END"


def _rank(x: str, p: float) -> str:
    return f"list_sort(list({x}))[(floor({p}::DOUBLE * (count(*) - 1) + 0.5) + 1)::BIGINT]"


def _hold(source: str, out: str) -> str:
    return f"""{out} AS (SELECT a.user_id, a.i, any_value(a.k) AS k, any_value(a.n) AS n, CASE WHEN any_value(a.n) > 80 THEN least(min(b.l + 0.24 * abs(a.i - b.i)), any_value(a.k) * 0.24, (any_value(a.n) - any_value(a.k) + 1) * 0.24) ELSE any_value(a.l) END AS l FROM {source} a JOIN {source} b ON b.user_id = a.user_id AND abs(a.i - b.i) <= 20 GROUP BY a.user_id, a.i)"""


def _crest(source: str, out: str) -> str:
    return f"{out} AS (SELECT user_id, i, k, n, CASE WHEN n > 80 AND k > 40 AND k + 40 <= n THEN least(l, (avg(l) OVER (w ROWS BETWEEN 40 PRECEDING AND 7 PRECEDING) + avg(l) OVER (w ROWS BETWEEN 7 FOLLOWING AND 40 FOLLOWING)) / 2 + 1.29) ELSE l END AS l FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY i))"


_NEARBY = "10 * log10(avg(pow(10, ({}) / 10)) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) + 1e-30)"
WORDS = PLAN + f""", wa AS (SELECT user_id, i, db, nfl, g, db + 3 * sin(i / 7.0::DOUBLE) AS bo FROM pg), wl AS (SELECT *, {_NEARBY.format("db")} AS ls, {_NEARBY.format("bo")} AS lb, {_NEARBY.format("bo + g")} AS lo FROM wa),
 wp AS (SELECT user_id, count(*) AS n, {_rank("ls", 0.7)} AS ps, {_rank("lb", 0.7)} AS pb, {_rank("lo", 0.7)} AS po, {_rank("db", 0.7)} AS pr, {_rank("bo", 0.7)} AS pw, {_rank("lb", 0.1)} AS p10, {_rank("lb", 0.9)} AS p90 FROM wl GROUP BY user_id),
 w1 AS (SELECT *, least({_over("(ps - ls)")}, {_over("(pb - lb)")}) AS low, {_over("(po - lo)")} AS od, pr > db AND pw > bo AS act FROM wl JOIN wp USING (user_id)), w2 AS (SELECT *, least(3.6, low * 0.62) - (low - od) AS v FROM w1),
 w3 AS (SELECT *, CASE WHEN low > 0 THEN least(3.6, {_over("v")}) / (1 + exp(-(lb - (nfl + 8)) / 4)) * (1 - 0.6 * {_ramp("(ls - lb - 6) / 6")}) ELSE 0 END AS rq, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, act ORDER BY i) AS isl FROM w2),
 w4 AS (SELECT *, count(*) OVER (PARTITION BY user_id, act, isl) * 10.0::DOUBLE AS ms FROM w3), w5 AS (SELECT *, CASE WHEN act THEN pow({_ramp("ms / 300")}, 4) * (1 - 0.75 * {_ramp("(ms - 1000) / 800")}) ELSE 0 END AS wo FROM w4),
 w6 AS (SELECT user_id, sum(w) AS tot, max(w) AS top FROM (SELECT user_id, act, isl, sum(rq * wo) AS w FROM w5 GROUP BY ALL) GROUP BY user_id),
 w7 AS (SELECT user_id, i, k, n, rq * wo * CASE WHEN tot > 0 THEN {_ramp("(1 - top / tot) / 0.5")} ELSE 0 END * 0.825 / (1 + exp(-(p90 - p10 - 5) / 2)) * (1 - 0.12 * {_ramp("(p90 - p10 - 12) / 8")}) AS l FROM w5 JOIN w6 USING (user_id)),
 w8 AS (SELECT a.user_id, a.i, any_value(a.k) AS k, any_value(a.n) AS n, max(b.l - 0.24 * abs(a.i - b.i)) AS l FROM w7 a JOIN w7 b ON b.user_id = a.user_id AND abs(a.i - b.i) <= 20 GROUP BY a.user_id, a.i),
 {_crest("w8", "crs1")}, {_hold("crs1", "crs2")}, {_crest("crs2", "crs3")}, {_hold("crs3", "crs4")}, wx AS (SELECT user_id, i, g, least({HIGH}, g + CASE WHEN n >= 30 THEN l ELSE 0 END) AS gain FROM crs4 JOIN wa USING (user_id, i))"""  # fmt: skip


def words(spark, sf_dir):
    """The words stage, each long series taken as one run."""
    d = planned(long_levels(spark, sf_dir), again=False).withColumn("speech_body", C("db") + 3 * F.sin(C("frame_idx") / 7)).withColumn("active", F.lit(True)).withColumn("run_id", F.lit(0))
    return painting.stabilize_words(d, KEYS, "db", "speech_body", "gain", "active", "floor", HIGH, out="lifted", run="run_id")


@query(WORDS + " SELECT user_id AS series, i::BIGINT AS frame_idx, round(gain, 6) AS gain FROM wx")
def word_levels(spark, sf_dir):
    return _shown(words(spark, sf_dir).drop("gain").withColumnRenamed("lifted", "gain"))


@query(PLAN + """, ca AS (SELECT user_id, i, g, g + 2 * sin(i / 2.0::DOUBLE) AS c FROM pg), sm AS (SELECT *, sum(greatest(0.24, coalesce(abs(g - pv), 0)) ) OVER (PARTITION BY user_id ORDER BY i) AS a FROM (SELECT *, lag(g) OVER (PARTITION BY user_id ORDER BY i) AS pv FROM ca))
 SELECT a.user_id AS series, a.i::BIGINT AS frame_idx, round(min(b.c + abs(a.a - b.a)), 6) AS gain FROM sm a JOIN sm b ON b.user_id = a.user_id AND abs(a.i - b.i) <= 120 GROUP BY a.user_id, a.i""")  # fmt: skip
def kept_edges(spark, sf_dir):
    """A plan with a ripple of 2 dB, held to the plan's own steps; beyond 120 frames the ripple cannot matter."""
    d = planned(long_levels(spark, sf_dir)).withColumn("active", F.lit(True)).withColumn("rippled", C("gain") + 2 * F.sin(C("frame_idx") / 2))
    return _shown(painting.keep_edges(d, KEYS, "gain", "rippled", "active"))
