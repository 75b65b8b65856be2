"""Spectra of written tones, frame choice against plain loops, tone deltas."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import spectrum as sp

RATE, N = 16_000, 320


def tone(hz, n=N, gain=0.3):
    return (np.sin(2 * math.pi * hz * np.arange(n) / RATE) * gain).tolist()


def plain_powers(x, rate=RATE):
    """By the definition, sample by sample."""
    out = []
    for hz in sp.probes(rate):
        p = 0.0
        for f in hz:
            re = sum(v * 0.5 * (1 - math.cos(2 * math.pi * i / (len(x) - 1))) * math.cos(2 * math.pi * f * i / rate) for i, v in enumerate(x))
            im = sum(v * 0.5 * (1 - math.cos(2 * math.pi * i / (len(x) - 1))) * math.sin(2 * math.pi * f * i / rate) for i, v in enumerate(x))
            p += (re * re + im * im) / len(x) ** 2
        out.append(p / len(hz))
    return out


def framed(spark, series):
    rows = [(k, i, x, h) for k, fs in series.items() for i, (x, h) in enumerate(fs)]
    return spark.createDataFrame(rows, "k int, frame_idx long, samples array<double>, heard boolean")


def test_band_powers_of_tones(spark):
    rows = [(k, tone(hz)) for k, hz in enumerate(sp.BANDS[:7])] + [(20, None), (21, [0.0] * 5), (22, [float("nan")] * N), (23, [0.0] * N)]
    got = {r["k"]: r["b"] for r in spark.createDataFrame(rows, "k int, x array<double>").select("k", sp.band_powers(F.col("x"), RATE).alias("b")).collect()}
    for k, hz in enumerate(sp.BANDS[:7]):
        assert got[k]["powers"] == pytest.approx(plain_powers(rows[k][1]), rel=1e-6, abs=1e-15)
        assert int(np.argmax(got[k]["powers"])) == k or hz < 120
        assert got[k]["rms"] == pytest.approx(math.sqrt(np.mean(np.square(rows[k][1]))))
    assert all(got[k]["powers"] is None and got[k]["rms"] is None for k in (20, 21, 22)) and got[23]["rms"] == 0


def test_chosen_frames_and_fallbacks(spark):
    """Every n-th heard frame; all frames where no heard one counts; nothing where none does."""
    series = {
        1: [(tone(100 * (i + 1)), i % 3 > 0) for i in range(20)],
        2: [(tone(500), False)] * 7,
        3: [([0.0] * N, True)] * 3 + [(tone(800), False)] * 3,
        4: [([0.0] * N, True)] * 4,
        5: [(tone(700), True)],
    }
    got = {r["k"]: r for r in sp.log_band_spectrum(framed(spark, series), ["k"], RATE, 4).collect()}
    chosen = {1: [i for i in range(20) if i % 3][:: math.ceil(13 / 4)][:4], 2: [0, 2, 4, 6], 3: [4], 5: [0]}
    for k, at in chosen.items():
        powers = np.mean([plain_powers(series[k][i][0]) for i in at], axis=0)
        assert got[k]["band_db"] == pytest.approx((10 * np.log10(powers + 1e-30)).tolist(), abs=1e-6)
        assert got[k]["counted"] == len(at) and got[k]["gated"] == (k in (1, 5))
    assert got[4]["band_db"] == [-120.0] * 8 and got[4]["counted"] == 0


@pytest.mark.parametrize("most", [1, 3, 50])
def test_event_frames_lie_evenly(spark, most):
    rng = np.random.default_rng(most)
    series = {k: [(rng.normal(0, 0.1, N).tolist() if i % 4 else tone(5800), bool(rng.random() < 0.7)) for i in range(n)] for k, n in ((1, 17), (2, 4), (3, 1))} | {9: [(tone(6000), False)] * 3}
    got = {r["k"]: r["authority"] for r in sp.event_sibilance(framed(spark, series), ["k"], RATE, most).collect()}
    for k, frames in series.items():
        heard = [i for i, (_, h) in enumerate(frames) if h]
        if len(heard) > most:
            heard = [heard[(len(heard) - 1) // 2]] if most == 1 else [heard[math.floor(j * (len(heard) - 1) / (most - 1) + 0.5)] for j in range(most)]
        scores = []
        for i in heard:
            db = [10 * math.log10(p + 1e-30) for p in plain_powers(frames[i][0])]
            scores.append(min(1.0, max(0.0, ((db[6] + db[7] - db[4] - db[5]) / 2 + 1) / 9)))
        want = min(0.5, math.sqrt(sum(s * s for s in scores) / len(scores))) if scores else 0.0
        assert got[k] == pytest.approx(want, abs=1e-6)


def test_frames_of_another_cadence(spark):
    frames = framed(spark, {1: [(None, None)] * 6}).drop("heard")
    activity = spark.createDataFrame([(1, i, i in (3, 11)) for i in range(16)], "k int, activity_idx long, active boolean")
    got = [r["heard"] for r in sp.overlapping(frames, activity, ["k"], RATE, 7.5).orderBy("frame_idx").collect()]
    want = [any(f * 20 < (a + 1) * 7.5 and (f + 1) * 20 > a * 7.5 for a in (3, 11)) for f in range(6)]
    assert got == want


def test_tone_delta_and_cuts(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 9.0], [0.0, 0.0, 0.0, 0.0, 5.0])], "a array<double>, b array<double>")
    def delta(**more):
        return d.select(sp.tone_delta(F.col("a"), F.col("b"), 1.5, **more).alias("x")).first()["x"]
    assert delta() == [1.5, 1.5, 0.75, -1.5]
    assert delta(priority=1, priority_most=4.0) == [1.5, 1.5, 0.75, -4.0]
    assert delta(house=(4.0, 0.0, 0.0, 0.0), blend=0.5) == [3.0, 1.25, 0.25, -3.0]
    cuts = spark.createDataFrame([(0.5,), (2.0,), (None,), (float("nan"),)], "s double").select(sp.de_esser_cuts(F.col("s")).alias("c")).collect()
    assert [tuple(r["c"]) for r in cuts] == [(-1.0, -0.6), (-4.0, -2.4), (0.0, 0.0), (0.0, 0.0)]
