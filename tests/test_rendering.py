"""Render segments against plain loops, with batches of two rows so that state is handed on all the time."""

from __future__ import annotations

import random

import pytest

from cadenza.operators import rendering, sequential


def plain_cuts(silences, total, target=30.0, most=42.0):
    at, out = 0.0, []
    while at < total - 0.02:
        low, ideal, high = (min(total, at + d) for d in (target * 0.55, target, most))
        best, cut = None, high
        for a, b in silences:
            middle = (a + b) / 2
            if b - a >= 0.4 and low <= middle <= high and (best is None or abs(middle - ideal) < best):
                best, cut = abs(middle - ideal), middle
        if cut <= at + 0.25:
            cut = ideal
        end = max(at + 0.1, cut)
        quiet = [any(b - a >= 0.5 and a <= t <= b for a, b in silences) for t in (at, end)]
        out.append((at, end, *quiet))
        at = end
    return out


def lines(seed):
    rng = random.Random(seed)
    t, silences = 0.0, []
    while t < 400:
        t += rng.expovariate(0.2)
        length = rng.choice([0.1, 0.4, 0.5, 2.0, 30.0])
        silences.append((round(t, 3), round(t + length, 3)))
        t += length if rng.random() < 0.9 else 0.0
    return sorted(silences), rng.uniform(100, 450)


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cuts_against_a_loop(spark, small_batches):
    made = {k: lines(k) for k in range(12)} | {None: lines(99), 50: ([], 100.0), 51: ([(0.0, 100.0)], 100.0), 52: ([], 0.01)}
    silences = spark.createDataFrame([(k, a, b) for k, (s, _) in made.items() if k is not None for a, b in s], "k int, a double, b double")
    lengths = spark.createDataFrame([*((k, t) for k, (_, t) in made.items()), (60, None), (61, float("nan")), (62, -1.0)], "k int, total double")
    got: dict = {}
    for r in rendering.cuts(silences, lengths, ["k"], "a", "b", "total").orderBy("k", "segment").collect():
        assert r["segment"] == len(got.setdefault(r["k"], []))
        got[r["k"]].append((r["seg_start"], r["seg_end"], r["quiet_start"], r["quiet_end"]))
    want = {k: plain_cuts(s if k is not None else [], t) for k, (s, t) in made.items()}
    assert got == {k: v for k, v in want.items() if v}


def plain_merge(segments, longest, most):
    out = [dict(s) for s in segments]
    while sum(s["process"] for s in out) > most:
        free = [(s["end"] - s["start"], i) for i, s in enumerate(out[1:-1], 1) if not s["process"] and out[i - 1]["process"] and out[i + 1]["process"] and s["end"] - s["start"] <= longest]
        if not free:
            break
        _, i = min(free)
        a, b = out[i - 1], out[i + 1]
        out[i - 1 : i + 2] = [{"start": a["start"], "end": b["end"], "process": True, "into": a["into"], "out": b["out"], "guarded": a["guarded"] or b["guarded"]}]
    return [(s["start"], s["end"], s["process"], s["into"], s["out"], s["guarded"]) for s in out]


def test_merging_against_a_loop(spark):
    rng, rows, want = random.Random(4), [], {}
    for k in range(40):
        t, segments = 0.0, []
        for i in range(rng.randint(1, 14)):
            length = rng.choice([0.5, 0.5, 1.0, 2.0, 3.5])
            segments.append({"start": t, "end": t + length, "process": rng.random() < 0.6, "into": i, "out": 100 + i, "guarded": False})
            segments[-1]["guarded"] = segments[-1]["process"] and rng.random() < 0.3
            t += length
        rows += [(k, i, *s.values()) for i, s in enumerate(segments)]
        want[k] = plain_merge(segments, 2.0, 3)
    d = spark.createDataFrame(rows, "k int, segment int, seg_start double, seg_end double, process boolean, trim_in_ms int, trim_out_ms int, guarded boolean")
    got: dict = {}
    for r in rendering.merge_for_risk(d, ["k"], 2.0, 3).orderBy("k", "segment").collect():
        got.setdefault(r["k"], []).append((r["seg_start"], r["seg_end"], r["process"], r["trim_in_ms"], r["trim_out_ms"], r["guarded"]))
    assert got == want


def test_pads(spark):
    """A cut at the middle of a long silence, one where there is none, and the last segment with speech."""
    silences = spark.createDataFrame([(1, 28.0, 31.0), (1, 80.0, 100.0)], "k int, s_start double, s_end double")
    speech = spark.createDataFrame([(1, 0.0, 28.0), (1, 31.0, 80.0)], "k int, s_start double, s_end double")
    lengths = spark.createDataFrame([(1, 130.0)], "k int, total double")
    rows = rendering.segments(silences, speech, lengths, ["k"], "s_start", "s_end", "total").orderBy("segment").collect()
    got = [(r["seg_start"], r["seg_end"], r["process"], r["guarded"], r["trim_in_ms"], r["trim_out_ms"]) for r in rows]
    assert got == [(0.0, 29.5, True, True, 160 + 80, 220), (29.5, 71.5, True, False, 0, 320), (71.5, 90.0, True, True, 240, 220), (90.0, 130.0, False, False, 0, 0)]


def test_render_window(spark):
    rows = [(0, 10.0, 2.0, 4.0, False), (1, 10.0, 2.0, 4.0, True), (2, 10.0, 12.0, 14.0, False), (3, None, 0.0, 1.0, True), (4, 10.0, 3.0, 3.05, False), (5, 10.0, -1.0, 1.0, False)]
    d = spark.createDataFrame(rows, "k int, total double, a double, b double, first boolean")
    from pyspark.sql import functions as F

    w = rendering.render_window(1000, F.col("total"), F.col("a"), F.col("b"), F.col("first"), leading=0.25, trailing=0.5, overlap=0.02, trim=0.03)
    got = {r["k"]: tuple(r["w"]) for r in d.select("k", w.alias("w")).collect()}
    assert got[0] == (1030, 4520, 1000, 2960, 2030, 3990, None) and got[1] == (1750, 4520, 280, 2240, 2030, 3990, None)
    assert [got[k][-1] for k in (2, 3, 4, 5)] == ["empty segment", "time not finite or negative", "trim leaves nothing", "time not finite or negative"]


def test_state_is_handed_over_batches(spark, small_batches):
    rows = [(k, i) for k in ("a", None, "b") for i in range(7)]
    d = spark.createDataFrame(rows, "k string, i int")
    got = sequential.stepwise(d, ["k"], ["i"], ["i"], "sum", "int", lambda row, s: (s + row[0], s + row[0]), 0).collect()
    assert {(r["k"], r["i"], r["sum"]) for r in got} == {(k, i, i * (i + 1) // 2) for k, i in rows}
