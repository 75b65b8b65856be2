"""Registered queries on the authority of evidence, echo cleanup, matched levels and comparable metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import evidence as ev
from cadenza.plans.queries import FR, KEY, frames, query, r, table

C = F.col


@query(FR + """, f AS (SELECT user_id, frame_idx, value >= 50 AS sp, least(30000, frame_idx * 20.0)::DOUBLE AS s, least(30000, frame_idx * 20.0 + 20 + event_id % 5 * 8)::DOUBLE AS e FROM fr),
 q AS (SELECT *, coalesce(max(e) FILTER (sp) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM f),
 g AS (SELECT user_id, avg(sp::INT) AS share, coalesce(sum(greatest(0, e - greatest(s, c))) FILTER (sp), 0) / 1000 AS sec FROM q GROUP BY user_id)
 SELECT user_id, round(share, 6) AS speech_share, round(sec, 6) AS speech_seconds, round(least(1, greatest(0, (share - 0.08) / 0.22)), 6) AS share_authority, round(least(1, greatest(0, (sec - 2) / 8)), 6) AS seconds_authority FROM g""")  # fmt: skip
def speech_authority(spark, sf_dir):
    """Frames of 20 ms, some of which reach into later ones, in sources of 30 s."""
    start = C("frame_idx") * 20.0
    d = frames(spark, sf_dir).select("user_id", "frame_idx", (C("value") / 100).alias("p"), start.alias("s"), (start + 20 + C("event_id") % 5 * 8).alias("e"), F.lit(30000.0).alias("whole"))
    d = ev.speech_authority(d, KEY, "frame_idx", "p", "s", "e", "whole")
    return d.select("user_id", *(r(c).alias(c) for c in ("speech_share", "speech_seconds", "share_authority", "seconds_authority")))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk, l_suppkey % 4 <> 0 AS en, l_suppkey % 2 = 0 AS ke, l_quantity / 50 AS ec, l_discount * 10 AS cf, l_tax * 8 AS pn, l_extendedprice / 50000 AS nt, l_tax * 5 AS fr, l_discount * 6 AS cr, CASE WHEN l_partkey % 7 <> 0 THEN l_quantity * 2 END AS dl FROM lineitem),
 a AS (SELECT *, en AND risk <> 'low' AND cf >= 0.5 AS rd FROM d), b AS (SELECT *, rd AND (ec >= 0.68 OR (risk = 'high' AND ec >= 0.56 AND nt >= 0.72) OR (risk = 'medium' AND ec >= 0.6 AND nt >= 0.82)) AS dominant, rd AND risk = 'high' AND (ec >= 0.72 OR (ec >= 0.64 AND nt >= 0.98)) AS severe FROM a)
 SELECT l_orderkey, l_linenumber, dominant, severe, severe OR (dominant AND ec >= 0.56) AS dereverb, ke AND severe AND least(1, pn) <= 0.42 AND greatest(least(1, fr), least(1, cr) * 0.85) < 0.36 AS tail_gate,
 round(CASE WHEN severe AND dl BETWEEN 24 AND 90 THEN least(0.4, greatest(0.16, 0.14 + least(1, ec) * 0.22 + (1 - least(1, cf)) * 0.14 + least(0.6, greatest(-0.3, nt)) * 0.04)) ELSE 0 END::DOUBLE, 6) AS cancel, round(least(1, greatest(0, (0.8 - ec) / (0.8 - 0.2)))::DOUBLE, 6) AS deficit FROM b""")  # fmt: skip
def echo_cleanup(spark, sf_dir):
    k, echo, confidence, notch = C("l_partkey"), C("l_quantity") / 50, C("l_discount") * 10, C("l_extendedprice") / 50000
    risk = F.when(k % 3 == 0, "high").when(k % 3 == 1, "medium").otherwise("low")
    made = ev.echo_cleanup(risk, C("l_suppkey") % 4 != 0, C("l_suppkey") % 2 == 0, echo, confidence, C("l_tax") * 8, notch, C("l_tax") * 5, C("l_discount") * 6)
    cancel = ev.echo_cancel_strength(C("e.severe"), echo, confidence, F.when(k % 7 != 0, C("l_quantity") * 2), notch)
    return table(spark, sf_dir, "lineitem").withColumn("e", made).select("l_orderkey", "l_linenumber", "e.*", r(cancel).alias("cancel"), r(ev.deficit(echo, 0.8, 0.2)).alias("deficit"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN -o_totalprice / 10000 END AS s, CASE WHEN o_orderkey % 11 <> 0 THEN -o_totalprice / 9000 END AS i FROM orders),
 m AS (SELECT o_custkey, count(*) = count(s) AS has_s, count(*) = count(i) AS has_i, min(s) AS low_s, min(i) AS low_i FROM t GROUP BY 1)
 SELECT o_custkey, o_orderkey, CASE WHEN has_s THEN 'speech-k-weighted' WHEN has_i THEN 'integrated-loudness' ELSE 'unavailable' END AS metric, round(CASE WHEN has_s THEN low_s WHEN has_i THEN low_i END, 6) AS target_db,
 round(CASE WHEN has_s THEN low_s - s WHEN has_i THEN low_i - i ELSE 0 END, 6) AS trim_db FROM t JOIN m USING (o_custkey)""")  # fmt: skip
def level_match(spark, sf_dir):
    """A customer's orders as tracks that are heard in turn."""
    k, price = C("o_orderkey"), C("o_totalprice")
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.when(k % 7 != 0, -price / 10000).alias("s"), F.when(k % 11 != 0, -price / 9000).alias("i"))
    return ev.level_match(d, ["o_custkey"], "s", "i").select("o_custkey", "o_orderkey", "metric", r("target_db").alias("target_db"), r("trim_db").alias("trim_db"))


@query("""SELECT c_custkey AS key, c_acctbal AS source_value, s_acctbal AS rendered_value, floor((s_acctbal - c_acctbal) * 1e6 + 0.5) / 1e6 AS delta, c_custkey % 2 = 0 AS higher_is_better
 FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey % 3 <> 0 AND s_nationkey % 4 <> 0 AND (c_custkey % 2 = 0) = (s_suppkey % 6 <> 1 AND s_suppkey % 2 = 0)""")  # fmt: skip
def metric_deltas(spark, sf_dir):
    k, s = C("c_custkey"), C("s_suppkey")
    source = table(spark, sf_dir, "customer").select(k.alias("key"), (C("c_nationkey") % 3 != 0).alias("available"), C("c_acctbal").alias("value"), (k % 2 == 0).alias("higher_is_better"))
    rendered = table(spark, sf_dir, "supplier").select(s.alias("key"), (C("s_nationkey") % 4 != 0).alias("available"), C("s_acctbal").alias("value"), ((s % 6 != 1) & (s % 2 == 0)).alias("higher_is_better"))
    return ev.metric_deltas(source, rendered, ["key"])
