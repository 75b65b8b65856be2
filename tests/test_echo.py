"""Echo taps, blends and tail gains against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest

from cadenza.operators import echo


def frames(spark, series, size):
    rows = [(k, f, x[a : a + size]) for k, x in series.items() for f, a in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "k int, frame_idx long, samples array<double>")


def signal(seed, n=1003, delay=130, tap=-0.2):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, n)
    x[300:380] = 0
    for i in range(delay, n):
        x[i] += tap * x[i - delay]
    return x.tolist()


@pytest.mark.parametrize("size", [50, 64, 400])
def test_tap_and_blend(spark, size):
    series = {1: signal(1), 2: signal(2, tap=0.0), 3: signal(3, n=100), 4: [1.0] * 400}
    d = frames(spark, series, size)
    taps = echo.residual_tap(d, ["k"], size, 130).cache()
    got = {r["k"]: r["tap"] for r in taps.collect()}
    out: dict = {}
    for r in echo.delay_blend(d, taps, ["k"], size, 130).orderBy("k", "frame_idx").collect():
        out.setdefault(r["k"], []).extend(r["samples"])
    for k, x in series.items():
        num = den = 0.0
        for i in range(130, len(x), 8):
            if abs(x[i]) >= 2e-5:
                num += x[i - 130] * x[i]
                den += x[i - 130] ** 2
        tap = min(0.12, max(-0.36, num / (den + 1e-9)))
        assert got[k] == pytest.approx(tap)
        want = [v if i < 130 or abs(tap) < 0.03 else min(1.0, max(-1.0, v - 0.65 * tap * x[i - 130])) for i, v in enumerate(x)]
        assert out[k] == pytest.approx(want)
    assert got[1] < -0.1 and got[4] == 0.12


def levels(seed, n=400):
    rng, out, db = random.Random(seed), [], -60.0
    for i in range(n):
        phase = (i // 50) % 4
        db = {0: -60 + rng.random(), 1: -20 + rng.uniform(-3, 3), 2: db - 0.6, 3: -45 + rng.uniform(-4, 4)}[phase]
        out.append((i, db, db > -48))
    return out


def plain(rows, least, start, full, depth, floor, decay):
    body = float(np.quantile([d for _, d, _ in rows], 0.85))
    run, since, previous, away, out = 0, 9999, 0, 9999, []
    close = lambda n: max(floor, 1 - depth * min(1.0, max(0.0, n / (full - start))))
    for i, db, speech in rows:
        target = 1.0
        if speech:
            run, since = run + 1, 0
            if db >= body - 8:
                away = 0
            else:
                away += 1
                coming = any(d >= body - 8 for _, d, _ in rows[i + 1 : i + 26])
                if decay and run >= least and away >= start and db <= body - 10 and not coming:
                    target = close(away - start)
        else:
            previous = run if since == 0 else previous
            run, since, away = 0, since + 1, away + 1
            if previous >= least and since >= start:
                target = close(since - start)
        out.append(target)
    return out


def test_targets_and_gains(spark):
    series = {k: levels(k) for k in range(4)} | {9: [(i, -60.0, False) for i in range(30)]}
    d = spark.createDataFrame([(k, *row) for k, rows in series.items() for row in rows], "k int, frame_idx long, db double, speech boolean")
    for o, made, decay in ((echo.STRICT, echo.strict_targets(d, ["k"]), False), (echo.FINISH, echo.finishing_targets(d, ["k"], 10.0), True)):
        found = echo.asymmetric(made, ["k"], "target", o["attack"], o["release"]).orderBy("k", "frame_idx").collect()
        for k, rows in series.items():
            want = plain(rows, o["least_run"], o["start"], o["full"], o["depth"], o["floor"], decay)
            mine = [r for r in found if r["k"] == k]
            assert [r["target"] for r in mine] == pytest.approx(want)
            gain, gains = 1.0, []
            for t in want:
                gain += (t - gain) * (o["attack"] if t < gain else o["release"])
                gains.append(gain)
            assert [r["gain"] for r in mine] == pytest.approx(gains)
        assert min(r["target"] for r in found) < 0.2


def test_gains_go_evenly_from_frame_to_frame(spark):
    d = spark.createDataFrame([(1, 0, [1.0] * 4, 1.0), (1, 1, [1.0] * 4, 0.2), (1, 2, [1.0, 1.0], 0.6)], "k int, frame_idx long, samples array<double>, gain double")
    out = [r["samples"] for r in echo.apply_gains(d, ["k"]).orderBy("frame_idx").collect()]
    assert out == [[1.0] * 4, pytest.approx([1.0, 0.8, 0.6, 0.4]), pytest.approx([0.2, 0.4])]
