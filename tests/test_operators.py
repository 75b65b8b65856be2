"""Operators on synthetic series: brute force, and properties that must hold whatever the data."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.functions import scalar as sc
from cadenza.operators import frames, greedy, intervals, joins, masks, runs, signals, windows


def series(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, frame_idx long, x double")


def column(df, name):
    return [r[name] for r in df.orderBy("frame_idx").collect()]


def sections(*parts):
    return [a + (b - a) * i / max(1, n - 1) for n, a, b in parts for i in range(n)]


def test_scalars_guard_nan_null_and_halves(spark):
    d = spark.createDataFrame([(float("nan"),), (None,), (-2.5,), (2.5,), (0.0,)], "x double")
    got = d.select(sc.clamp(F.col("x"), -1, 1).alias("c"), sc.half_up(F.col("x")).alias("h"), sc.to_db(F.col("x")).alias("db")).collect()
    assert [r["c"] for r in got] == [None, None, -1.0, 1.0, 0.0] and [r["h"] for r in got][2:] == [-2, 3, 0] and got[4]["db"] == -120 and got[1]["db"] is None
    safe = spark.range(1).select(sc.all_present(F.least(F.lit(1.0), F.lit(None).cast("double")), F.lit(None)).alias("v"), sc.null_aware_mean((F.lit(2.0), 1.0), (F.lit(None).cast("double"), 3.0)).alias("m")).first()
    assert (safe["v"], safe["m"]) == (0.0, 2.0)


def test_percentile_rules_differ(spark):
    d = spark.createDataFrame([("a", v, 1.0) for v in (1.0, 2.0, 3.0, 10.0)], "k string, x double, w double")
    r = d.groupBy("k").agg(pct.linear(F.col("x"), 0.8).alias("l"), pct.nearest_rank(F.col("x"), 0.8).alias("n"), pct.lower_median(F.col("x")).alias("m")).first()
    assert math.isclose(r["l"], 5.8) and r["n"] == 3.0 and r["m"] == 2.0
    assert pct.weighted_step(d, ["k"], "x", "w", 0.5, "o").first()["o"] == 2.0
    assert pct.weighted_midpoint(d.withColumn("id", F.monotonically_increasing_id()), ["k"], "x", "w", 0.5, "o", "id").first()["o"] == 2.5
    assert pct.mad_filtered_median(d, ["k"], "x", "o").first()["o"] == 2.0


def test_mask_passes_in_order(spark):
    flags = [0, 0, 1, 1, 1, 0, 1, 0, 0, 1, 1, 1, 1, 0]
    d = spark.createDataFrame([("a", i, bool(f)) for i, f in enumerate(flags)], "k string, frame_idx long, on boolean")
    got = column(runs.finalize_mask(d, ["k"], "on", 2, 4), "on")
    assert got == [False, False, *[True] * 11, False]
    found = runs.runs(d, ["k"], "on").where("on").orderBy("start_frame").collect()
    assert [(r["start_frame"], r["end_frame"]) for r in found] == [(2, 5), (6, 7), (9, 13)]
    assert [r["members"] for r in runs.gap_clusters(d.where("on"), ["k"], "frame_idx", 2).orderBy("first").collect()] == [4, 4]


def test_hysteresis_on_sections(spark):
    db = sections((60, -74, -74), (20, -29, -29), (8, -62, -62), (6, -66, -66), (30, -18, -18), (20, -74, -74))
    mask = masks.hysteresis(np.array(db), -74.0)
    assert not mask[:59].any() and mask[61:88].all() and mask[95:124].all() and not mask[-3:].any()
    assert not masks.hysteresis(np.array(sections((50, -80, -80), (2, -20, -20), (50, -80, -80))), -80.0).any()
    df = masks.activity_mask(series(spark, db).withColumnRenamed("x", "db"), "k")
    assert all(column(df, "active")[61:124])  # the short gap between the two is bridged


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-90, 0), min_size=0, max_size=80), st.floats(-90, -40))
def test_hysteresis_properties(levels, floor):
    x = np.array(levels)
    mask = masks.hysteresis(x, floor)
    assert len(mask) == len(x)
    opens = np.clip(floor + 11.5, -58, -24)
    assert not mask.any() or masks.smoothed(x)[mask.argmax()] >= opens


def test_slew_envelopes_against_loops(spark):
    rng = random.Random(1)
    x = [rng.uniform(-5, 5) for _ in range(60)]
    up, down = list(x), list(x)
    for order in (range(1, 60), range(58, -1, -1)):
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            up[i], down[i] = max(up[i], up[j] - 0.3), min(down[i], down[j] + 0.3)
    d = series(spark, x).select("*", windows.slew_majorant("x", ["k"], 0.3).alias("up"), windows.slew_minorant("x", ["k"], 0.3).alias("down"))
    assert np.allclose(column(d, "up"), up) and np.allclose(column(d, "down"), down)


def test_activity_distance_and_halo(spark):
    d = series(spark, [0, 0, 1, 0, 0, 0, 1, 0])
    assert column(d.select("*", windows.active_distance(F.col("x") > 0, ["k"]).alias("d")), "d") == [2, 1, 0, 1, 2, 1, 0, 1]
    assert column(d.select("*", windows.protection_halo("x", ["k"], 1).alias("h")), "h") == [0, 0.5, 1, 0.5, 0, 0.5, 1, 0.5]


def test_intervals(spark):
    d = spark.createDataFrame([("a", 0.0, 2.0), ("a", 1.0, 3.0), ("a", 3.01, 4.0), ("a", 6.0, 7.0)], "k string, s double, e double")
    merged = intervals.merge(d, ["k"], "s", "e", 0.02)
    assert sorted((r["s"], r["e"]) for r in merged.collect()) == [(0.0, 4.0), (6.0, 7.0)]
    free = intervals.complement(merged, spark.createDataFrame([("a", -1.0, 9.0)], "k string, low double, high double"), ["k"], "s", "e", 0.5)
    assert sorted((r["s"], r["e"]) for r in free.collect()) == [(-1.0, 0.0), (4.0, 6.0), (7.0, 9.0)]
    w = spark.createDataFrame([("a", 1, 3.0, 7.0), ("a", 2, 100.0, 101.0), ("b", 3, 0.0, 1.0)], "k string, id long, w_start double, w_end double")
    spans = merged.toDF("k", "s_start", "s_end")
    for bucket in (0.5, 50.0):
        got = {r["id"]: r["occupancy"] for r in intervals.occupancy(w, spans, ["k"], "id", bucket).collect()}
        assert got == {1: pytest.approx(0.5), 2: 0.0, 3: 0.0}


def test_lag_search_finds_a_shift(spark):
    rng = random.Random(4)
    x = [rng.uniform(0, 1) for _ in range(120)]
    pairs = joins.lagged_pairs(series(spark, x), series(spark, [0, 0, 0, *x]).withColumnRenamed("x", "y"), ["k"], range(-5, 6))
    scores = pairs.groupBy("k", "lag").agg((-F.avg(F.abs(F.col("x") - F.col("y")))).alias("s"))
    best = joins.best_lag(scores, ["k"], "s").first()
    assert best["lag"] == 3 and best["best"] == 0


def test_nearest_match_rejects_ties(spark):
    a = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("a", 9.0)], "k string, t double")
    b = spark.createDataFrame([("a", 0.5, 10), ("a", 1.5, 11), ("a", 5.2, 12), ("a", 20.0, 13)], "k string, t double, v int")
    got = {r["t"]: r["matched_v"] for r in joins.nearest_match(a, b, ["k"], "t", 1.0, "v").collect()}
    assert got == {1.0: None, 5.0: 12, 9.0: None}


def test_greedy_rules(spark):
    d = spark.createDataFrame([("a", i, float(s)) for i, s in enumerate([4, 4, 4, 20, 1, 1, 1])], "k string, i long, size double")
    assert [r["part"] for r in greedy.next_fit_parts(d, "k", ["i"], "size", 10, 2).orderBy("i").collect()] == [0, 0, 1, 2, 3, 3, 4]
    f = spark.createDataFrame([("a", i, i in (1, 2, 5, 8)) for i in range(10)], "k string, frame_idx long, hit boolean")
    assert [r["frame_idx"] for r in greedy.refractory(f, "k", "frame_idx", "hit", 3).where("event").orderBy("frame_idx").collect()] == [1, 5]
    assert column(greedy.keyframes(series(spark, [0, 0.5, 1.2, 1.1, 0]), "k", "frame_idx", "x", 1.0).where("emitted"), "x") == [0, 1.2, 0]
    p = spark.createDataFrame([("a", 95.0, 97.0, 250.0), ("a", 103.0, 109.0, 250.0)], "k string, s double, e double, total double")
    assert [(r["chunk_start"], r["chunk_end"]) for r in greedy.plan_chunks(p, "k", "s", "e", "total", 100.0, 10.0).orderBy("chunk").collect()] == [(0.0, 106.0), (106.0, 206.0), (206.0, 250.0)]


def test_filters_against_a_loop_and_each_other(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(50)
    c = signals.high_pass(48_000, 120, 0.7071)
    y, x1, x2, y1, y2 = [], 0.0, 0.0, 0.0, 0.0
    for v in x:
        now = c[0] * v + c[1] * x1 + c[2] * x2 - c[3] * y1 - c[4] * y2
        x1, x2, y1, y2 = v, x1, now, y1
        y.append(now)
    d = spark.createDataFrame([(x.tolist(),)], "s array<double>")
    r = d.select(signals.biquad(F.col("s"), c).alias("a"), signals.biquad_long(c)("s").alias("b")).first()
    assert np.allclose(r["a"], y) and np.allclose(r["b"], y)
    assert abs(sum(signals.low_pass(48_000, 120, 0.7071)[:3]) - 1 - sum(signals.low_pass(48_000, 120, 0.7071)[3:])) < 1e-9
    assert len(signals.high_shelf(48_000, 1500, 0.7071, 4.0)) == 5


def test_band_power_against_fft(spark):
    x = np.random.default_rng(5).standard_normal(64)
    p = np.abs(np.fft.rfft(x)) ** 2 / 64
    got = spark.createDataFrame([(x.tolist(),)], "s array<double>").select(signals.band_power_db(F.col("s"), 64, [(1, 2), (5, 9)]).alias("b")).first()["b"]
    assert np.allclose(got, [10 * math.log10(p[1:3].mean()), 10 * math.log10(p[5:10].mean())])


def test_frames_and_arrays(spark):
    d = spark.createDataFrame([(1, [1.0, -1.0, 1.0, -1.0, 0.5]), (2, [])], "id long, s array<double>")
    r = frames.frame_stats(d, ["id"], "s", 2).orderBy("id", "frame_idx").collect()
    assert len(r) == 2 and abs(r[0]["db"]) < 1e-6 and r[0]["peak"] == 1.0
    e = d.select("id", signals.envelope(F.col("s"), 2).alias("e"), signals.to_mono(F.col("s"), 2).alias("m"), signals.resample(2, 4)("s").alias("r")).orderBy("id").collect()
    assert e[0]["e"] == [1.0, 1.0, 0.5] and e[0]["m"] == [0.0, 0.0] and len(e[0]["r"]) == 10 and e[1]["e"] == [] == e[1]["m"]
    g = d.where("id = 1").select(signals.apply_gain(F.col("s"), F.array(F.lit(0.0), F.lit(0.0)), 2).alias("g")).first()["g"]
    assert g == [1.0, -1.0, 1.0, -1.0, 0.5]


def test_static_gain_moves_no_contrast(spark):
    rng = random.Random(8)
    x = [rng.uniform(-40, -20) for _ in range(80)]
    a, b = (column(series(spark, v).select("*", windows.shoulder_contrast("x", ["k"], 4, 20, 4).alias("c")), "c") for v in (x, [v + 6 for v in x]))
    assert all((p is None and q is None) or abs(p - q) < 1e-9 for p, q in zip(a, b))


def test_pairing_reasons(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 3), ("z", 4)], "key string, l long")
    b = spark.createDataFrame([("x", 9), ("y", 8), ("w", 7)], "key string, r long")
    got = {r["key"]: (r["status"], r["left_id"], r["right_id"]) for r in joins.pair_one_to_one(a, b, "key", "l", "r").collect()}
    assert got == {"x": ("paired", 1, 9), "y": ("ambiguous", None, None), "z": ("no_result", None, None), "w": ("no_source", None, None)}


def test_ten_frame_windows_against_brute_force(spark):
    from cadenza.plans.relations import ten_frame_windows

    rng = np.random.default_rng(21)
    series = {u: rng.standard_normal(n).round(3).tolist() for u, n in ((1, 9), (2, 10), (3, 33), (4, 200))}
    rows = [(u, i, 1000 * u + i, x) for u, xs in series.items() for i, x in enumerate(xs)]
    want = set()
    for u, xs in series.items():
        chosen = []
        for _, at in sorted((-round(sum(xs[i : i + 10]) / 10, 9), i) for i in range(len(xs) - 9)):
            if len(chosen) < 5 and all(abs(at - c) >= 10 for c in chosen):
                chosen.append(at)
        want |= {(u, at) for at in chosen}
    got = ten_frame_windows(spark.createDataFrame(rows, "user_id long, frame_idx int, event_id long, db double")).collect()
    assert {(r["user_id"], r["frame_idx"]) for r in got} == want and len(got) == len(want)


def test_preferred_row_against_all_others_and_counted_differences(spark):
    from cadenza.operators import ranking

    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 3.0), (1, 3, None), (2, 1, 5.0), (3, 2, 2.0), (4, 1, 1.0), (4, 2, 3.0)], "g long, n int, x double")
    pairs = ranking.preferred_over_others(df, "g", F.col("n") == 1, ["x"])
    assert sorted((r["g"], r["x"]) for r in pairs.collect()) == [(1, -2.0), (1, 1.0), (4, -2.0)]
    w = 0.0
    for _ in range(5):
        w -= 0.08 * (sum(x / (1 + math.exp(-w * x)) for x in (-2.0, 1.0, -2.0)) / 3 + 0.0015 * w)
    assert abs(ranking.fit(pairs, ["x"], steps=5)[0] - w) < 1e-12
