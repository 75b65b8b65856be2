"""Registered queries on timelines: a user's merged event spans as speech, what is between them as silence, an hour as a second."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadenza.operators import intervals, rendering
from cadenza.plans.queries import KEY, MERGED, query, r, spans, table

C = F.col
#: mg2 (spans), si (silences) and le (lengths) in hours from a user's start.
LINE = MERGED.replace("WITH sp AS", "WITH RECURSIVE sp AS") + """, b AS (SELECT user_id, min(s_start) - 100 AS low, max(s_end) + 100 AS high FROM sp GROUP BY user_id), le AS MATERIALIZED (SELECT user_id, (high - low) / 3600 AS total FROM b),
 mg2 AS MATERIALIZED (SELECT user_id, (s_start - low) / 3600 AS a, (s_end - low) / 3600 AS e FROM mg JOIN b USING (user_id)),
 p AS (SELECT user_id, a, e FROM mg2 UNION ALL SELECT user_id, total, total FROM le), q AS (SELECT user_id, coalesce(max(e) OVER (PARTITION BY user_id ORDER BY a, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, a AS e FROM p),
 si AS MATERIALIZED (SELECT user_id, a, e FROM q WHERE e > a)"""  # fmt: skip
_T, _M = rendering.TARGET, rendering.MOST
CUTS = LINE + f""", ct AS (SELECT user_id, 0 AS segment, 0::DOUBLE AS s, 0::DOUBLE AS e, total FROM le UNION ALL
 SELECT user_id, segment + 1, any_value(e), greatest(any_value(e) + 0.1, coalesce(arg_min(m, (abs(m - least(total, e + {_T})), x)), any_value(least(total, e + {_M})))), any_value(total)
 FROM (SELECT ct.*, si.a AS x, (si.a + si.e) / 2 AS m FROM ct LEFT JOIN si ON si.user_id = ct.user_id AND si.e - si.a >= {rendering.LEAST_SILENCE} AND (si.a + si.e) / 2 BETWEEN least(ct.total, ct.e + {_T} * {rendering.EARLIEST}) AND least(ct.total, ct.e + {_M})
 WHERE ct.e < ct.total - 0.02) GROUP BY user_id, segment),
 sg AS (SELECT user_id, segment - 1 AS segment, s, e FROM ct WHERE segment > 0),
 oc AS (SELECT sg.*, coalesce((SELECT sum(greatest(0, least(sg.e, m.e) - greatest(sg.s, m.a))) FROM mg2 m WHERE m.user_id = sg.user_id AND m.e > sg.s AND m.a < sg.e), 0) / (e - s) AS occ,
 EXISTS (SELECT 1 FROM si WHERE si.user_id = sg.user_id AND si.e - si.a >= {rendering.LONG_SILENCE} AND sg.s BETWEEN si.a AND si.e) AS qs, EXISTS (SELECT 1 FROM si WHERE si.user_id = sg.user_id AND si.e - si.a >= {rendering.LONG_SILENCE} AND sg.e BETWEEN si.a AND si.e) AS qe FROM sg),
 pr AS (SELECT *, occ >= {rendering.LEAST_SPEECH} AS pr FROM oc), gd AS (SELECT *, pr AND (qe OR segment = max(segment) FILTER (pr) OVER (PARTITION BY user_id)) AS gd FROM pr),
 sx AS MATERIALIZED (SELECT *, CASE WHEN NOT pr OR qs THEN 0 WHEN gd THEN 240 ELSE 160 END AS ti, CASE WHEN NOT pr THEN 0 WHEN qe THEN CASE WHEN gd THEN 220 ELSE 140 END WHEN gd THEN 580 ELSE 320 END AS tu FROM gd)"""  # fmt: skip


def hours(spark, sf_dir):
    """Speech spans, silences and lengths: (user_id, s_start, s_end), the same, (user_id, total)."""
    every = spans(spark, sf_dir)
    bounds = every.groupBy("user_id").agg((F.min("s_start") - 100).alias("from"), (F.max("s_end") + 100).alias("to"))
    merged = intervals.merge(every, KEY, "s_start", "s_end", 60.0).join(bounds, "user_id")
    speech = merged.select("user_id", *(((C(c) - C("from")) / 3600).alias(c) for c in ("s_start", "s_end")))
    lengths = bounds.select("user_id", ((C("to") - C("from")) / 3600).alias("total"))
    silences = intervals.complement(speech, lengths.select("user_id", F.lit(0.0).alias("low"), C("total").alias("high")), KEY, "s_start", "s_end")
    return speech, silences, lengths


def found(spark, sf_dir):
    speech, silences, lengths = hours(spark, sf_dir)
    return rendering.segments(silences, speech, lengths, KEY, "s_start", "s_end", "total")


@query(CUTS + " SELECT user_id, segment, round(s, 6) AS seg_start, round(e, 6) AS seg_end, round(occ, 6) AS occupancy, pr AS process, gd AS guarded, ti AS trim_in_ms, tu AS trim_out_ms FROM sx")
def render_segments(spark, sf_dir):
    """Cuts of about thirty hours in the silences between spans, with pads."""
    return found(spark, sf_dir).select("user_id", "segment", *(r(c).alias(c) for c in ("seg_start", "seg_end", "occupancy")), "process", "guarded", "trim_in_ms", "trim_out_ms")


#: Finer segments for merging: a span of a user and what follows it, processed by turns.
_PARTS = LINE + """, al AS (SELECT user_id, a AS s, e, true AS pr FROM mg2 UNION ALL SELECT user_id, a, e, false FROM si), sx AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) - 1 AS segment FROM al),
 fr AS (SELECT *, NOT pr AND lag(pr) OVER w AND lead(pr) OVER w AND e - s <= 6 AS free, sum(pr::INT) OVER (PARTITION BY user_id) - 20 AS over FROM sx WINDOW w AS (PARTITION BY user_id ORDER BY segment)),
 rk AS (SELECT *, coalesce(free, false) AND row_number() OVER (PARTITION BY user_id ORDER BY coalesce(free, false) DESC, e - s, segment) <= over AS gone FROM fr),
 gr AS (SELECT *, sum(CASE WHEN gone OR coalesce(lag_gone, false) THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY segment) AS g FROM (SELECT *, lag(gone) OVER (PARTITION BY user_id ORDER BY segment) AS lag_gone FROM rk))
 SELECT user_id, min(segment)::INT AS segment, count(*)::INT AS parts, round(min(s), 6) AS seg_start, round(max(e), 6) AS seg_end, bool_or(pr) AS process FROM gr GROUP BY user_id, g"""  # fmt: skip


@query(_PARTS)
def merged_segments(spark, sf_dir):
    """Spans with pauses of up to six hours between them, merged to twenty a user, the shortest pauses first."""
    from pyspark.sql import Window

    speech, silences, _ = hours(spark, sf_dir)
    parts = speech.withColumn("process", F.lit(True)).unionByName(silences.withColumn("process", F.lit(False)))
    # a span without length starts with the silence after it and comes first
    parts = parts.select("user_id", (F.row_number().over(Window.partitionBy("user_id").orderBy("s_start", "s_end")) - 1).alias("segment"), C("s_start").alias("seg_start"), C("s_end").alias("seg_end"), "process")
    parts = parts.withColumns({"trim_in_ms": F.lit(0), "trim_out_ms": F.lit(0), "guarded": F.lit(False)})
    d = rendering.merge_for_risk(parts, KEY, 6.0, 20)
    return d.select("user_id", "segment", "parts", r("seg_start").alias("seg_start"), r("seg_end").alias("seg_end"), "process")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, l_quantity AS whole, l_discount * 300 AS a, l_discount * 300 + l_tax * 100 AS b, l_linenumber = 1 AS first FROM lineitem),
 s AS (SELECT *, floor(whole * 8000 + 0.5)::BIGINT AS w, least(floor(a * 8000 + 0.5)::BIGINT, floor(whole * 8000 + 0.5)::BIGINT) AS x, floor(b * 8000 + 0.5)::BIGINT AS y0 FROM o), t AS (SELECT *, greatest(x, least(y0, w)) AS y FROM s),
 e AS (SELECT *, CASE WHEN y <= x THEN 'empty segment' WHEN y - x <= 1600 THEN 'trim leaves nothing' END AS error, x + 800 AS oa, least(w, y - 800 + 400) AS ob, CASE WHEN first THEN greatest(0, x - 1600) ELSE least(greatest(0, x - 1600), greatest(0, x + 800 - 8000)) END AS ra, least(w, y + 2400 + 400) AS rb FROM t)
 SELECT l_orderkey, l_linenumber, CASE WHEN error IS NULL THEN ra END::BIGINT AS read_start, CASE WHEN error IS NULL THEN rb END::BIGINT AS read_end, CASE WHEN error IS NULL THEN oa - ra END::BIGINT AS trim_start, CASE WHEN error IS NULL THEN ob - ra END::BIGINT AS trim_end,
 CASE WHEN error IS NULL THEN oa END::BIGINT AS output_start, CASE WHEN error IS NULL THEN ob END::BIGINT AS output_end, error FROM e""")  # fmt: skip
def render_windows(spark, sf_dir):
    """What is read and what is kept of an order's lines as segments at 8 kHz."""
    a = C("l_discount") * 300
    w = rendering.render_window(8000, C("l_quantity"), a, a + C("l_tax") * 100, C("l_linenumber") == 1, leading=0.2, trailing=0.3, overlap=0.05, trim=0.1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", w.alias("w")).select("l_orderkey", "l_linenumber", "w.*")
