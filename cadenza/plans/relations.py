"""Registered queries on pairing, scoring, job tables, strings and arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions import scalar as sc
from cadenza.operators import greedy, joins, masks, runs, scoring, signals, windows
from cadenza.operators import frames as fr
from cadenza.plans.queries import FR, KEY, RUNS, active, big, frames, query, r, table

TWO = FR + ", a AS (SELECT user_id, frame_idx, db FROM fr)"


@query(FR + """, l AS (SELECT unnest(generate_series(4, 20)) AS lag) SELECT a.user_id, lag::BIGINT AS lag, count(*)::BIGINT AS pairs, round(CASE WHEN sqrt(sum(a.value * a.value) * sum(b.value * b.value)) > 0
 THEN sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)) ELSE 0 END, 6) AS correlation FROM fr a, l, fr b WHERE a.user_id = b.user_id AND b.frame_idx = a.frame_idx + lag GROUP BY a.user_id, lag""")  # fmt: skip
def lag_autocorrelation(spark, sf_dir):
    c = joins.lag_correlation(frames(spark, sf_dir), KEY, "value", range(4, 21))
    return c.select("user_id", "lag", "pairs", r("correlation").alias("correlation"))


@query(FR + """, l AS (SELECT unnest(generate_series(-5, 5)) AS lag), p AS (SELECT a.user_id, lag, b.db - a.db AS d FROM fr a, l, fr b WHERE a.user_id + 1 = b.user_id AND b.frame_idx = a.frame_idx + lag),
 m AS (SELECT *, median(d) OVER (PARTITION BY user_id, lag) AS md FROM p), s AS (SELECT user_id, lag, median(abs(d - md)) AS disp, count(*) AS n FROM m GROUP BY user_id, lag HAVING count(*) >= 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(disp, 9), abs(lag), lag) AS rk FROM s)
 SELECT user_id, lag::BIGINT AS lag, round(disp, 6) AS dispersion, n::BIGINT AS pairs FROM k WHERE rk = 1""")  # fmt: skip
def lag_alignment(spark, sf_dir):
    """The lag at which a series and the next one differ by the steadiest offset: least median absolute deviation."""
    d = frames(spark, sf_dir).select("user_id", "frame_idx", "db")
    right = d.select((F.col("user_id") - 1).alias("user_id"), "frame_idx", F.col("db").alias("other"))
    pairs = joins.lagged_pairs(d, right, KEY, range(-5, 6)).select("user_id", "lag", (F.col("other") - F.col("db")).alias("d"))
    spread = pairs.withColumn("m", F.median("d").over(Window.partitionBy("user_id", "lag"))).groupBy("user_id", "lag").agg(F.median(F.abs(F.col("d") - F.col("m"))).alias("dispersion"), F.count("*").alias("pairs")).where("pairs >= 20")
    best = runs.top_per_group(spread, KEY, [F.round("dispersion", 9), F.abs("lag"), F.col("lag")], 1)
    return best.select("user_id", "lag", r("dispersion").alias("dispersion"), "pairs")


@query("""WITH a AS (SELECT c_custkey AS k, count(*) AS nl, min(c_custkey) AS l FROM customer GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS nr, min(o_orderkey) AS rr FROM orders GROUP BY 1)
 SELECT coalesce(a.k, b.k)::BIGINT AS customer, coalesce(nl, 0)::BIGINT AS n_left, coalesce(nr, 0)::BIGINT AS n_right, CASE WHEN nl = 1 AND nr = 1 THEN l END::BIGINT AS left_id, CASE WHEN nl = 1 AND nr = 1 THEN rr END::BIGINT AS right_id,
 CASE WHEN nl = 1 AND nr = 1 THEN 'paired' WHEN nl IS NULL THEN 'no_source' WHEN nr IS NULL THEN 'no_result' ELSE 'ambiguous' END AS status FROM a FULL JOIN b ON a.k = b.k""")  # fmt: skip
def pair_full_outer(spark, sf_dir):
    """Customers with their only order; those with several are ambiguous, those with none have no result."""
    a = table(spark, sf_dir, "customer").select(big("c_custkey").alias("customer"), "c_custkey")
    b = table(spark, sf_dir, "orders").select(big("o_custkey").alias("customer"), "o_orderkey")
    return joins.pair_one_to_one(a, b, "customer", "c_custkey", "o_orderkey")


@query("""WITH p AS (SELECT o_custkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'before' ELSE 'after' END AS role, o_orderkey, o_totalprice FROM orders),
 f AS (SELECT o_custkey, role, arg_min(o_totalprice, o_orderkey) AS price FROM p GROUP BY o_custkey, role)
 SELECT a.o_custkey, round(a.price, 4) AS o_totalprice_before, round(b.price, 4) AS o_totalprice_after, round(b.price - a.price, 4) AS o_totalprice_delta FROM f a JOIN f b ON a.o_custkey = b.o_custkey AND a.role = 'before' AND b.role = 'after'""")  # fmt: skip
def before_after_compare(spark, sf_dir):
    role = F.when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "before").otherwise("after")
    d = joins.before_after(table(spark, sf_dir, "orders"), "o_custkey", role, [F.col("o_orderkey")], ["o_totalprice"])
    return d.select("o_custkey", *(r(c, 4).alias(c) for c in d.columns[1:]))


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) / 1e6 AS t, value FROM events), a AS (SELECT * FROM e WHERE event_type = (SELECT min(event_type) FROM e)), b AS (SELECT * FROM e WHERE event_type = (SELECT max(event_type) FROM e)),
 p AS (SELECT a.event_id, abs(a.t - b.t) AS away, b.value FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) <= 3600), m AS (SELECT event_id, min(away) AS away FROM p GROUP BY event_id),
 h AS (SELECT p.event_id, count(*) AS n, min(p.value) AS v, min(p.away) AS away FROM p JOIN m ON p.event_id = m.event_id AND p.away = m.away GROUP BY p.event_id)
 SELECT a.event_id, CASE WHEN n = 1 THEN round(v, 6) END AS matched_value, CASE WHEN n = 1 THEN round(h.away, 4) END AS distance FROM a LEFT JOIN h ON a.event_id = h.event_id""")  # fmt: skip
def nearest_match(spark, sf_dir):
    """The nearest event of the last type within an hour of each of the first type; none if two are as near."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    ends = e.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    a = e.join(F.broadcast(ends.select(F.col("a").alias("event_type"))), "event_type").withColumn("__row", F.col("event_id"))
    b = e.join(F.broadcast(ends.select(F.col("b").alias("event_type"))), "event_type")
    return joins.nearest_match(a, b, KEY, "t", 3600.0, "value").select("event_id", r("matched_value").alias("matched_value"), r("distance", 4).alias("distance"))


#: Measurements of an order's lines from 0 to 1, some of them missing.
LINES = """WITH li AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS instability, CASE WHEN l_linenumber % 3 <> 0 THEN l_discount * 10 END AS onset, l_tax * 10 AS jump, CASE WHEN l_partkey % 4 <> 0 THEN (l_partkey % 100) / 100.0 END AS swing,
 (l_suppkey % 10) / 10.0 AS sag, (l_partkey % 7) / 7.0 AS end_fade, (l_suppkey % 3) / 3.0 AS breath, CASE WHEN l_suppkey % 5 <> 0 THEN l_discount * 8 END AS pause, (l_linenumber % 5) / 5.0 AS click,
 CASE WHEN l_partkey % 6 <> 0 THEN l_tax * 12 END AS compression, CASE WHEN l_suppkey % 7 <> 0 THEN (l_suppkey % 11) / 11.0 END AS echo, (l_partkey % 2) * 0.5 AS clip FROM lineitem)"""  # fmt: skip


def measured(spark, sf_dir, *others: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        *others,
        "l_orderkey", "l_linenumber", (c("l_quantity") / 50).alias("instability"), F.when(c("l_linenumber") % 3 != 0, c("l_discount") * 10).alias("onset"), (c("l_tax") * 10).alias("jump"),
        F.when(c("l_partkey") % 4 != 0, (c("l_partkey") % 100) / 100.0).alias("swing"), ((c("l_suppkey") % 10) / 10.0).alias("sag"), ((c("l_partkey") % 7) / 7.0).alias("end_fade"), ((c("l_suppkey") % 3) / 3.0).alias("breath"),
        F.when(c("l_suppkey") % 5 != 0, c("l_discount") * 8).alias("pause"), ((c("l_linenumber") % 5) / 5.0).alias("click"), F.when(c("l_partkey") % 6 != 0, c("l_tax") * 12).alias("compression"),
        F.when(c("l_suppkey") % 7 != 0, (c("l_suppkey") % 11) / 11.0).alias("echo"), ((c("l_partkey") % 2) * 0.5).alias("clip"),
    )


def _mean_sql(weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({c} * {w}, 0)" for c, w in weights.items())
    return f"({top}) / nullif({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in weights.items())}, 0)"


COMPOSITE = f"""{LINES}, ct AS (SELECT l_orderkey, l_linenumber, {_mean_sql(scoring.STABILITY)} AS s, {_mean_sql(scoring.PAUSE)} AS p, compression AS c, echo AS e FROM li),
 mn AS (SELECT *, {_mean_sql(dict.fromkeys("spce", 1.0))} AS m FROM ct), sc AS (SELECT l_orderkey, l_linenumber, s, p, coalesce(coalesce(s, m) * 1000 + coalesce(p, m) * 100 + coalesce(c, m) * 10 + coalesce(e, m), 1111) AS total FROM mn)"""


def composites(spark, sf_dir) -> DataFrame:
    d = measured(spark, sf_dir).withColumn("s", scoring.category(scoring.STABILITY)).withColumn("p", scoring.category(scoring.PAUSE))
    return d.withColumn("total", scoring.composite(F.col("s"), F.col("p"), F.col("compression"), F.col("echo")))


@query(COMPOSITE + " SELECT l_orderkey, l_linenumber, round(s, 6) AS stability, round(p, 6) AS pause, round(total, 4) AS total FROM sc")
def null_aware_composite(spark, sf_dir):
    return composites(spark, sf_dir).select("l_orderkey", "l_linenumber", r("s").alias("stability"), r("p").alias("pause"), r("total", 4).alias("total"))


_RISK_SQL = "least(1, greatest(0, " + " + ".join(f"coalesce({c}, 0) * {w}" for c, w in scoring.RISK.items()) + "))"


@query(f"{LINES} SELECT l_orderkey, l_linenumber, round({_RISK_SQL}, 6) AS overall, CASE WHEN {_RISK_SQL} >= 0.56 OR instability >= 0.74 OR coalesce(pause, 0) >= 0.72 OR click >= 0.66 THEN 'warning' ELSE 'ok' END AS status FROM li")
def overall_risk(spark, sf_dir):
    d = measured(spark, sf_dir).fillna(0.0)
    d = d.withColumn("overall", scoring.overall_risk())
    return d.select("l_orderkey", "l_linenumber", r("overall").alias("overall"), scoring.report_status().alias("status"))


GATES = """WITH g AS (SELECT l_orderkey, l_linenumber, (l_quantity - 25) / 200 AS dur, l_discount - 0.05 AS off, l_tax * 12 AS conf, CASE WHEN l_partkey % 3 <> 0 THEN -l_discount * 40 END AS peak, (l_suppkey % 10) / 10.0 AS ending FROM lineitem),
 pn AS (SELECT *, CASE WHEN abs(dur) > 0.05 THEN abs(dur) * 5200 ELSE 0 END + CASE WHEN conf >= 0.35 AND abs(off) > 0.08 THEN abs(off) * 2600 * least(1, greatest(0.25, conf)) ELSE 0 END
 + CASE WHEN peak > -1.5 THEN (peak + 1.5) * 900 ELSE 0 END + CASE WHEN ending > 0.62 THEN (ending - 0.62) * 1400 ELSE 0 END AS penalty FROM g)"""  # fmt: skip


def gated(spark, sf_dir) -> DataFrame:
    c = F.col
    d = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", ((c("l_quantity") - 25) / 200).alias("dur"), (c("l_discount") - 0.05).alias("off"), (c("l_tax") * 12).alias("conf"),
        F.when(c("l_partkey") % 3 != 0, -c("l_discount") * 40).alias("peak"), ((c("l_suppkey") % 10) / 10.0).alias("ending"),
    )
    return d.withColumn("penalty", scoring.gate_penalty(*(c(x) for x in ("dur", "off", "conf", "peak", "ending"))))


@query(GATES + " SELECT l_orderkey, l_linenumber, round(penalty, 4) AS penalty FROM pn")
def gate_penalties(spark, sf_dir):
    return gated(spark, sf_dir).select("l_orderkey", "l_linenumber", r("penalty", 4).alias("penalty"))


@query(GATES + """, x AS (SELECT l_orderkey, sum(CASE WHEN ending > 0.8 AND conf > 0.7 THEN 1 ELSE 0 END) AS cf, sum(CASE WHEN ending > 0.8 AND conf <= 0.7 THEN 1 ELSE 0 END) AS f, sum(CASE WHEN ending BETWEEN 0.45 AND 0.65 THEN 1 ELSE 0 END) AS mw,
 sum(CASE WHEN conf > 0.9 THEN 1 ELSE 0 END) AS w, sum(penalty) AS pen, max(off) * 500 AS learned FROM pn GROUP BY l_orderkey),
 y AS (SELECT *, cf * 1.2 + f * 0.8 + mw * 0.35 + w * 0.18 + least(1.5, pen / 1500) + greatest(0, learned / 250) AS risk FROM x), z AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN risk * 0.7 END AS rival FROM y)
 SELECT l_orderkey, round(risk, 6) AS risk, CASE WHEN coalesce(risk - rival >= 0.22 OR ((cf >= 1 OR cf + f >= 2 OR risk >= 2.1) AND rival + 0.05 < risk), false) THEN 'challenger' WHEN cf >= 1 OR cf + f >= 2 OR risk >= 2.1 THEN 'fail' ELSE 'pass' END AS verdict FROM z""")  # fmt: skip
def rule_assessment(spark, sf_dir):
    """Findings counted per order, a risk from them, and a verdict between the order and a rival."""
    c, ending, conf = F.col, F.col("ending"), F.col("conf")
    d = gated(spark, sf_dir).groupBy("l_orderkey").agg(
        F.count_if((ending > 0.8) & (conf > 0.7)).alias("cf"), F.count_if((ending > 0.8) & (conf <= 0.7)).alias("f"), F.count_if(ending.between(0.45, 0.65)).alias("mw"),
        F.count_if(conf > 0.9).alias("w"), sc.ordered_sum(c("penalty")).alias("pen"), (F.max("off") * 500).alias("learned"),
    )
    d = d.withColumn("risk", scoring.assessment_risk(*(c(x) for x in ("cf", "f", "mw", "w", "pen", "learned"))))
    d = d.withColumn("rival", F.when(c("l_orderkey") % 2 == 0, c("risk") * 0.7))
    return d.select("l_orderkey", r("risk").alias("risk"), scoring.verdict(c("cf"), c("f"), c("risk"), c("rival")).alias("verdict"))


_RANKED = COMPOSITE + ", rk AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(total, 6), l_linenumber) AS n, round(total, 6) AS t FROM sc)"


def ranked(spark, sf_dir) -> DataFrame:
    return runs.top_per_group(composites(spark, sf_dir).withColumn("t", r("total")), ["l_orderkey"], [F.col("t"), F.col("l_linenumber")], 2)


@query(_RANKED + " SELECT l_orderkey, max(l_linenumber) FILTER (n = 1) AS winner, max(l_linenumber) FILTER (n = 2) AS challenger, round(max(total) FILTER (n = 2) - max(total) FILTER (n = 1), 4) AS margin FROM rk GROUP BY l_orderkey")
def winner_challenger(spark, sf_dir):
    d, n = ranked(spark, sf_dir), F.col("rank")
    pick = lambda x, k: F.max(F.when(n == k, F.col(x)))
    return d.groupBy("l_orderkey").agg(pick("l_linenumber", 1).alias("winner"), pick("l_linenumber", 2).alias("challenger"), r(pick("total", 2) - pick("total", 1), 4).alias("margin"))


@query(_RANKED + """, p AS (SELECT l_orderkey, max(t) FILTER (n = 1) AS a, max(t) FILTER (n = 2) AS b, max(l_linenumber) FILTER (n = 1) AS w FROM rk GROUP BY l_orderkey)
 SELECT (l_orderkey % 10)::BIGINT AS fold, count(*)::BIGINT AS pairs, sum(CASE WHEN w = 1 + l_orderkey % 2 THEN 1 ELSE 0 END)::BIGINT AS agreed, round(avg(CASE WHEN w = 1 + l_orderkey % 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p WHERE b IS NOT NULL GROUP BY l_orderkey % 10""")  # fmt: skip
def pairwise_accuracy(spark, sf_dir):
    """How often the ranking's winner is the preferred line, by fold of orders."""
    d = winner_challenger(spark, sf_dir).where("challenger is not null")
    agreed = F.col("winner") == 1 + F.col("l_orderkey") % 2
    return d.groupBy((F.col("l_orderkey") % 10).alias("fold")).agg(F.count("*").alias("pairs"), F.count_if(agreed).alias("agreed"), r(F.avg(agreed.cast("double"))).alias("accuracy"))


@query("""WITH u AS (SELECT user_id, median(value) AS level, count(*) AS n FROM events GROUP BY user_id), v AS (SELECT user_id % 5 AS batch, user_id, level, least(2, greatest(0.5, sqrt(n / 120.0))) AS w FROM u),
 p AS (SELECT *, (sum(w) OVER o - w / 2) / sum(w) OVER (PARTITION BY batch) AS pos, row_number() OVER o AS rn, count(*) OVER (PARTITION BY batch) AS files FROM v WINDOW o AS (PARTITION BY batch ORDER BY level, user_id ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, lag(level) OVER o AS pl, lag(pos) OVER o AS pp FROM p WINDOW o AS (PARTITION BY batch ORDER BY rn)),
 a AS (SELECT batch, coalesce(min_by(CASE WHEN rn = 1 THEN level ELSE pl * (1 - (0.5 - pp) / (pos - pp)) + level * (0.5 - pp) / (pos - pp) END, rn) FILTER (pos >= 0.5), max(level)) AS anchor FROM l GROUP BY batch)
 SELECT l.user_id, round(anchor, 6) AS anchor, round(CASE WHEN files >= 2 AND abs(anchor - level) > 0.5 THEN least(2, greatest(-2, anchor - level)) ELSE 0 END, 6) AS offset_db FROM l JOIN a ON l.batch = a.batch""")  # fmt: skip
def batch_anchor_offsets(spark, sf_dir):
    """Series levels moved toward the weighted midpoint of their batch, within bounds."""
    from cadenza.functions.percentiles import weighted_midpoint

    level = table(spark, sf_dir, "events").groupBy("user_id").agg(F.median("value").alias("level"), F.count("*").alias("n"))
    level = level.withColumn("batch", F.col("user_id") % 5).withColumn("w", scoring.vote_weight(F.col("n")))
    anchor = weighted_midpoint(level, ["batch"], "level", "w", 0.5, "anchor", "user_id").join(level.groupBy("batch").agg(F.count("*").alias("files")), "batch")
    out = level.join(anchor, "batch")
    return out.select("user_id", r("anchor").alias("anchor"), r(scoring.batch_offset(F.col("anchor"), F.col("level"), F.col("files"))).alias("offset_db"))


@query(FR + """, t AS (SELECT user_id, frame_idx, db, quantile_cont(db, 0.5) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS tm FROM fr)
 SELECT user_id, frame_idx::BIGINT AS frame_idx, round(tm - db, 6) AS depth FROM t WHERE db <= tm - 18""")  # fmt: skip
def trailing_median_dropouts(spark, sf_dir):
    d = frames(spark, sf_dir).withColumn("tm", windows.trailing_percentile("db", KEY, 12, 0.5))
    return d.where(F.col("db") <= F.col("tm") - 18).select("user_id", "frame_idx", r(F.col("tm") - F.col("db")).alias("depth"))


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_type ELSE p_type || ' (' || n || ')' END AS label FROM (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part)")
def duplicate_suffix(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("p_type").orderBy("p_partkey"))
    d = table(spark, sf_dir, "part").select("p_partkey", "p_type", n.alias("n"))
    return d.select("p_partkey", F.when(F.col("n") == 1, F.col("p_type")).otherwise(F.format_string("%s (%d)", "p_type", "n")).alias("label"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY f) AS types FROM (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY user_id, event_type) GROUP BY user_id")
def ordered_distinct(spark, sf_dir):
    """Distinct types in the order in which each series first has them."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("f"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "event_type"))), lambda s: s["event_type"]), ",").alias("types"))


@query("SELECT o_custkey, o_orderstatus AS status_to, lag_status AS status_from, count(*)::BIGINT AS n FROM (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS lag_status FROM orders) WHERE lag_status <> o_orderstatus GROUP BY 1, 2, 3")
def status_transitions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status_to"), F.lag("o_orderstatus").over(w).alias("status_from"))
    return d.where("status_from <> status_to").groupBy("o_custkey", "status_to", "status_from").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey)
 SELECT o_orderkey, CASE WHEN greatest(o_orderdate, coalesce(last, o_orderdate)) < TIMESTAMP '1995-06-17' THEN 'expired' ELSE 'live' END AS state FROM orders LEFT JOIN u ON o_orderkey = l_orderkey WHERE o_orderstatus = 'O'""")  # fmt: skip
def stale_jobs_left_join(spark, sf_dir):
    """Open orders whose own date and last line are both past a deadline have expired."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last"))
    d = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").join(lines, "o_orderkey", "left")
    seen = F.greatest("o_orderdate", F.coalesce("last", "o_orderdate"))
    return d.select("o_orderkey", F.when(seen < F.lit("1995-06-17").cast("timestamp_ntz"), "expired").otherwise("live").alias("state"))


@query("SELECT user_id, event_type, min(event_id) AS event_id, arg_min(round(value, 6), event_id) AS value FROM events GROUP BY user_id, event_type")
def idempotent_dedupe(spark, sf_dir):
    """Of the requests with one (owner, key) the first stands."""
    d = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("event_id", "value")).alias("s"))
    return d.select("user_id", "event_type", "s.event_id", r("s.value").alias("value"))


@query("""SELECT user_id, (epoch_us(ts) // 3600000000)::BIGINT AS win, count(*)::BIGINT AS calls, greatest(0, count(*) - 3)::BIGINT AS refused FROM events GROUP BY 1, 2""")
def fixed_window_counts(spark, sf_dir):
    """Calls by owner and fixed hour, and how many a limit of three refuses."""
    win = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long")
    d = table(spark, sf_dir, "events").groupBy("user_id", win.alias("win")).agg(F.count("*").alias("calls"))
    return d.withColumn("refused", F.greatest(F.lit(0).cast("long"), F.col("calls") - 3))


_BANDS = [(1, 2), (3, 5), (6, 10), (11, 20)]
_PW = "(SELECT list_sum(list_transform(generate_series(0, 63), lambda i: embedding[i + 1]::DOUBLE * cos(2 * pi() * {k} * i / 64))) ** 2 + list_sum(list_transform(generate_series(0, 63), lambda i: embedding[i + 1]::DOUBLE * sin(2 * pi() * {k} * i / 64))) ** 2) / 64"


@query("SELECT vec_id, " + ", ".join(f"round(10 * log10(({' + '.join(_PW.format(k=k) for k in range(a, b + 1))}) / {b - a + 1} + 1e-30), 5) AS band{n}" for n, (a, b) in enumerate(_BANDS)) + " FROM embeddings")
def dft_band_power(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", signals.band_power_db(F.col("embedding"), 64, _BANDS).alias("b"))
    return d.select("vec_id", *(r(F.col("b")[n], 5).alias(f"band{n}") for n in range(len(_BANDS))))


@query("""WITH j AS (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT user_id, event_id, k, (k - lag(k) OVER (PARTITION BY user_id ORDER BY event_id))::BIGINT AS delta FROM j""")
def json_metric_delta(spark, sf_dir):
    d = table(spark, sf_dir, "events").select("user_id", "event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    return d.withColumn("delta", F.col("k") - F.lag("k").over(Window.partitionBy("user_id").orderBy("event_id")))


@query("SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '://([^?#]*)', 1)), '\\.html$|/$', ''), '[^a-z0-9]+', '-', 'g') AS key FROM pages")
def normalized_key(spark, sf_dir):
    """A key for pairing: lower case, no query, no suffix, separators alike."""
    bare = F.regexp_replace(F.lower(F.regexp_extract("url", "://([^?#]*)", 1)), r"\.html$|/$", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(bare, "[^a-z0-9]+", "-").alias("key"))


@query(FR + """ SELECT user_id, frame_idx::BIGINT AS frame_idx, round(greatest(max(db + 0.5 * frame_idx) OVER (PARTITION BY user_id ORDER BY frame_idx) - 0.5 * frame_idx,
 max(db - 0.5 * frame_idx) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 0.5 * frame_idx), 6) AS upper FROM fr""")  # fmt: skip
def slew_majorant(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "frame_idx", r(windows.slew_majorant("db", KEY, 0.5)).alias("upper"))


_HALO = "greatest(" + ", ".join(f"{'lag' if d > 0 else 'lead'}(value, {abs(d)}) OVER w * {1 - abs(d) / 5}" if d else "value" for d in range(-4, 5)) + ")"


@query(FR + f" SELECT user_id, frame_idx::BIGINT AS frame_idx, round({_HALO}, 6) AS halo FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx)")
def protection_halo(spark, sf_dir):
    return frames(spark, sf_dir).select("user_id", "frame_idx", r(windows.protection_halo("value", KEY, 4)).alias("halo"))


@query(RUNS + """, st AS (SELECT user_id, abs(db - lag(db) OVER (PARTITION BY user_id ORDER BY frame_idx)) AS d FROM ac WHERE active),
 i AS (SELECT user_id, quantile_cont(d, 0.8) AS p80, quantile_cont(d, 0.95) AS p95, count(d) AS n FROM st GROUP BY user_id),
 l AS (SELECT user_id, min(nf) AS nf, quantile_cont(db, 0.9) FILTER (active) - quantile_cont(db, 0.1) FILTER (active) AS dr, least(80, greatest(0, quantile_cont(db, 0.5) FILTER (active) - quantile_cont(db, 0.8) FILTER (NOT active))) AS ct FROM ac GROUP BY user_id)
 SELECT l.user_id, round(nf, 6) AS noise_floor, round(dr, 6) AS dynamic_range, round(ct, 6) AS contrast, round(CASE WHEN n >= 12 THEN 0.62 * least(1, greatest(0, (p80 - 1.2) / 3.1)) + 0.38 * least(1, greatest(0, (p95 - 2.2) / 4.6)) ELSE 0 END, 6) AS instability FROM l LEFT JOIN i USING (user_id)""")  # fmt: skip
def qc_metrics(spark, sf_dir):
    """One row of level metrics per series, as a quality report has them."""
    d = active(spark, sf_dir)
    on, off = F.when(F.col("active"), F.col("db")), F.when(~F.col("active"), F.col("db"))
    p = lambda x, q: F.percentile(x, F.lit(q))
    level = d.groupBy("user_id").agg(F.min("noise_floor").alias("nf"), (p(on, 0.9) - p(on, 0.1)).alias("dr"), sc.clamp(p(on, 0.5) - p(off, 0.8), 0.0, 80.0).alias("ct"))
    step = F.abs(F.col("db") - F.lag("db").over(Window.partitionBy("user_id").orderBy("frame_idx")))
    steps = d.where("active").select("user_id", step.alias("d")).groupBy("user_id").agg(p("d", 0.8).alias("p80"), p("d", 0.95).alias("p95"), F.count("d").alias("n"))
    out = level.join(steps, "user_id", "left")
    score = F.coalesce(scoring.instability(F.col("p80"), F.col("p95"), F.col("n")), F.lit(0.0))
    return out.select("user_id", r("nf").alias("noise_floor"), r("dr").alias("dynamic_range"), r("ct").alias("contrast"), r(score).alias("instability"))


@query("""WITH f AS (SELECT vec_id, k, list_slice(embedding, k * 16 + 1, k * 16 + 16) AS x FROM embeddings, (SELECT unnest(generate_series(0, 3)) AS k))
 SELECT vec_id, k::BIGINT AS frame_idx, round(sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE)) / 16), 6) AS rms, round(list_max(list_transform(x, lambda v: abs(v::DOUBLE))), 6) AS peak,
 round(greatest(-120, 20 * log10(sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v::DOUBLE)) / 16) + 1e-12)), 5) AS db,
 round(20 * log10(sqrt(list_sum(list_transform(generate_series(1, 16), lambda i: (x[i]::DOUBLE - (x[greatest(i - 1, 1)]::DOUBLE + x[least(i + 1, 16)]::DOUBLE) / 2) ** 2)) / 16) + 1e-12), 5) AS sharpness_db FROM f""")  # fmt: skip
def sample_frames(spark, sf_dir):
    d = fr.frame_stats(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 16)
    return d.select("vec_id", "frame_idx", r("rms").alias("rms"), r("peak").alias("peak"), r("db", 5).alias("db"), r("sharpness_db", 5).alias("sharpness_db"))


@query("SELECT vec_id, " + ", ".join(f"round(list_sum(list_transform(list_slice(embedding, {8 * k + 1}, {8 * k + 8}), lambda v: abs(v::DOUBLE))) / 8, 6) AS e{k}" for k in range(8)) + " FROM embeddings")
def sample_envelope(spark, sf_dir):
    d = table(spark, sf_dir, "embeddings").select("vec_id", signals.envelope(F.col("embedding"), 8).alias("e"))
    return d.select("vec_id", *(r(F.col("e")[k]).alias(f"e{k}") for k in range(8)))


#: SQL of sequential rules walks the series frame by frame in a recursive query.
WALK = FR.replace("WITH fr", "WITH RECURSIVE fr", 1)
_FILTER = signals.high_pass(64.0, 4.0, 0.7071)
_B0, _B1, _B2, _A1, _A2 = (f"({c!r}::DOUBLE)" for c in _FILTER)


@query(f"""WITH RECURSIVE st AS (SELECT vec_id, embedding AS v, 1 AS i, embedding[1]::DOUBLE AS x1, 0::DOUBLE AS x2, {_B0} * embedding[1]::DOUBLE AS y1, 0::DOUBLE AS y2 FROM embeddings
 UNION ALL SELECT vec_id, v, i + 1, v[i + 1]::DOUBLE, x1, {_B0} * v[i + 1]::DOUBLE + {_B1} * x1 + {_B2} * x2 - {_A1} * y1 - {_A2} * y2, y1 FROM st WHERE i < len(v)) SELECT vec_id, (i - 1)::BIGINT AS sample, round(y1, 6) AS filtered FROM st""")  # fmt: skip
def biquad_filter(spark, sf_dir):
    """A recursive filter over each array, one row a sample."""
    out = table(spark, sf_dir, "embeddings").select("vec_id", signals.biquad_long(_FILTER)("embedding").alias("filtered"))
    return out.select("vec_id", F.posexplode("filtered").alias("sample", "filtered")).select("vec_id", big("sample").alias("sample"), r("filtered").alias("filtered"))


_HYSTERESIS = WALK + """, nf AS (SELECT user_id, quantile_cont(db - 70, 0.25) AS fl FROM fr GROUP BY user_id),
 lv AS (SELECT fr.user_id, frame_idx AS i, db - 70 AS db, avg(db - 70) OVER (PARTITION BY fr.user_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS x, least(-24, greatest(-58, fl + 11.5)) AS op, least(-26, greatest(-60, fl + 8.5)) AS cl, fl + 14 AS so FROM fr JOIN nf USING (user_id)),
 cf AS MATERIALIZED (SELECT *, x >= op AND count(*) FILTER (x >= cl) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) >= 4 AS sure FROM lv),
 st AS (SELECT user_id, 0::BIGINT AS i, sure AS act, CASE WHEN sure THEN 14 ELSE 0 END AS hold, false AS used FROM cf WHERE i = 0
 UNION ALL SELECT user_id, i, CASE WHEN act THEN h >= 0 ELSE sure END, CASE WHEN act THEN greatest(h, 0) WHEN sure THEN 14 ELSE 0 END, act AND h >= 0 AND soft FROM (
  SELECT c.user_id, c.i, act, sure, x < op AND x < cl AND x >= so AND db >= so AS soft, CASE WHEN x >= op THEN 14 WHEN x >= cl THEN greatest(hold, 7) WHEN x >= so AND db >= so THEN CASE WHEN used THEN hold ELSE greatest(hold, 18) END - 1
  ELSE hold - CASE WHEN cl - x >= 8 THEN 3 WHEN cl - x >= 4 THEN 2 ELSE 1 END END AS h FROM st JOIN cf c ON c.user_id = st.user_id AND c.i = st.i + 1)),
 r0 AS (SELECT user_id, i, act, i - row_number() OVER (PARTITION BY user_id, act ORDER BY i) AS g FROM st), a0 AS (SELECT user_id, i, act AND count(*) OVER (PARTITION BY user_id, act, g) >= 6 AS act FROM r0),
 r1 AS (SELECT user_id, i, act, i - row_number() OVER (PARTITION BY user_id, act ORDER BY i) AS g FROM a0),
 e1 AS (SELECT *, count(*) OVER w AS len, min(i) OVER w AS first, max(i) OVER w AS last, max(i) OVER (PARTITION BY user_id) AS most FROM r1 WINDOW w AS (PARTITION BY user_id, act, g))
 SELECT user_id, i::BIGINT AS frame_idx, act OR (len <= 9 AND first > 0 AND last < most) AS active FROM e1"""  # fmt: skip


@query(_HYSTERESIS)
def hysteresis_mask(spark, sf_dir):
    """The sequential mask; its passes after the state machine are those of bridge_gaps."""
    return masks.activity_mask(frames(spark, sf_dir).withColumn("db", F.col("db") - 70), "user_id").select("user_id", "frame_idx", "active")


@query("""WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
 st AS (SELECT *, 0 AS part, o_totalprice AS total, 1 AS items FROM o WHERE k = 1
 UNION ALL SELECT o_custkey, o_orderkey, x, k, part + new::INT, CASE WHEN new THEN x ELSE total + x END, CASE WHEN new THEN 1 ELSE items + 1 END FROM (
  SELECT o.o_custkey, o.o_orderkey, o.o_totalprice AS x, o.k, part, total, items, total + o.o_totalprice > 500000 OR items >= 8 AS new FROM st JOIN o ON o.o_custkey = st.o_custkey AND o.k = st.k + 1))
 SELECT o_custkey, o_orderkey, o_totalprice, part::INT AS part FROM st""")  # fmt: skip
def next_fit_parts(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return greedy.next_fit_parts(d, "o_custkey", ["o_orderkey"], "o_totalprice", 500_000.0, 8)


@query(WALK + """, st AS (SELECT user_id, 0::BIGINT AS i, CASE WHEN db > 30 THEN 0::BIGINT END AS last, db > 30 AS event FROM fr WHERE frame_idx = 0
 UNION ALL SELECT user_id, i, CASE WHEN ev THEN i ELSE last END, ev FROM (SELECT f.user_id, f.frame_idx AS i, last, f.db > 30 AND (last IS NULL OR f.frame_idx - last > 4) AS ev FROM st JOIN fr f ON f.user_id = st.user_id AND f.frame_idx = st.i + 1))
 SELECT user_id, i AS frame_idx FROM st WHERE event""")  # fmt: skip
def refractory_events(spark, sf_dir):
    d = frames(spark, sf_dir).select("user_id", "frame_idx", (F.col("db") > 30).alias("loud"))
    return greedy.refractory(d, "user_id", "frame_idx", "loud", 4).where("event").select("user_id", "frame_idx")


@query(WALK + """, st AS (SELECT user_id, 0::BIGINT AS i, db AS last, true AS new FROM fr WHERE frame_idx = 0
 UNION ALL SELECT f.user_id, f.frame_idx, CASE WHEN abs(f.db - last) >= 6 THEN f.db ELSE last END, abs(f.db - last) >= 6 FROM st JOIN fr f ON f.user_id = st.user_id AND f.frame_idx = st.i + 1)
 SELECT user_id, i AS frame_idx, round(last, 6) AS db FROM st WHERE new""")  # fmt: skip
def gain_keyframes(spark, sf_dir):
    """Values that differ enough from the one emitted last."""
    d = frames(spark, sf_dir).select("user_id", "frame_idx", "db")
    return greedy.keyframes(d, "user_id", "frame_idx", "db", 6.0).where("emitted").select("user_id", "frame_idx", r("db").alias("db"))


@query(WALK + """, t AS (SELECT user_id, frame_idx, event_id, count(*) OVER w AS n, round(avg(db) OVER w, 9) AS m FROM fr WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
 c AS MATERIALIZED (SELECT user_id, frame_idx, m, row_number() OVER (PARTITION BY user_id ORDER BY m DESC, event_id) AS k FROM t WHERE n = 10),
 st AS (SELECT user_id, k, [frame_idx] AS chosen FROM c WHERE k = 1
 UNION ALL SELECT c.user_id, c.k, CASE WHEN len(chosen) < 5 AND len(list_filter(chosen, lambda x: abs(x - c.frame_idx) < 10)) = 0 THEN list_append(chosen, c.frame_idx) ELSE chosen END FROM st JOIN c ON c.user_id = st.user_id AND c.k = st.k + 1),
 p AS (SELECT user_id, unnest(arg_max(chosen, k)) AS frame_idx FROM st GROUP BY user_id) SELECT p.user_id, p.frame_idx::BIGINT AS frame_idx, round(m, 6) AS db FROM p JOIN c ON c.user_id = p.user_id AND c.frame_idx = p.frame_idx""")  # fmt: skip
def spaced_windows(spark, sf_dir):
    """The five loudest ten-frame windows of each series that do not overlap, by their mean level."""
    return ten_frame_windows(frames(spark, sf_dir)).select("user_id", "frame_idx", r("db").alias("db"))


def ten_frame_windows(d):
    """Any frame with nine after it may start a window; its level is the mean of the ten."""
    ten = Window.partitionBy("user_id").orderBy("frame_idx").rowsBetween(0, 9)
    d = d.select("user_id", "frame_idx", "event_id", F.count("*").over(ten).alias("n"), F.round(F.avg("db").over(ten), 9).alias("db")).where("n = 10").drop("n")
    return greedy.pick_apart(d, "user_id", "db", "event_id", "frame_idx", 10, 5).where("picked")
