"""Clicks: written signals, a plain scan sample by sample, and equality at every chunk size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cadenza.operators import clicks
from cadenza.operators.clicks import Reach, Stretch, click_counts, click_places, clicks_of

RATE = 16_000


def tone(n, hz=181.0, gain=0.035, rate=RATE):
    return (np.sin(2 * math.pi * hz * np.arange(n) / rate) * gain).astype(np.float32)


def chunked(spark, signals, size):
    rows = [(k, c, x[a : a + size].tolist()) for k, x in signals.items() for c, a in enumerate(range(0, len(x), size))]
    return spark.createDataFrame(rows, "series int, chunk int, samples array<float>")


def places(df, rate=RATE):
    out: dict = {}
    for r in click_places(df, ["series"], rate).orderBy("series", "sample").collect():
        out.setdefault(r["series"], []).append(r["sample"])
    return out


def noisy(seed, n=5000):
    rng = random.Random(seed)
    x = tone(n) + np.random.default_rng(seed).normal(0, 0.0005, n).astype(np.float32)
    for _ in range(8):
        at, w = rng.randrange(n - 100), rng.choice([1, 1, 3, 30, 64, 90])
        x[at : at + w] += rng.choice([-1, 1]) * rng.uniform(0.05, 0.5)
    at = rng.randrange(n // 3, n // 2)
    x[at:] += 0.2 * rng.choice([-1, 1])  # a level that stays
    x[2 * n // 3 :] = tone(n, gain=0.05)[: n - 2 * n // 3]  # another phase
    return x


def test_a_clean_tone_has_none_and_spikes_are_counted():
    x = tone(RATE)
    assert clicks_of(x, RATE) == []
    x[3000] += 0.4
    x[9000:9003] -= 0.5
    assert clicks_of(x, RATE) == [3000, 9000]
    x[3010] += 0.4  # within the rest after the first
    assert len(clicks_of(x, RATE)) == 2


def test_a_level_that_stays_and_a_jump_of_phase():
    x = tone(RATE)
    x[8000:] += 0.3
    assert clicks_of(x, RATE) == [8000]
    y = np.concatenate((tone(8000), tone(8000)))
    jump = abs(float(y[8000]) - float(y[7999]))
    assert clicks_of(y, RATE) == ([8000] if jump > clicks.LEAST_STEP else [])
    y = np.concatenate((tone(8022), -tone(8022)[::-1]))
    assert all(abs(i - 8022) < 3 for i in clicks_of(y, RATE))


def test_a_saw_is_no_click():
    """Steps that recur within 30 ms are the voice itself; pulses count wherever they stand alone."""
    x = (0.3 - (np.arange(RATE) % 100) * 0.003).astype(np.float32)
    assert clicks_of(x, RATE) == []
    y = np.zeros(RATE, np.float32)
    y[::200] = 0.5
    assert len(clicks_of(y, RATE)) == RATE // 200 - 1


@pytest.mark.parametrize("size", [37, 160, 1000, 4999, 5000])
def test_every_chunk_size_finds_the_same(spark, size):
    signals = {k: noisy(k) for k in range(4)} | {9: np.zeros(2, np.float32), 10: tone(900)}
    want = {k: v for k, x in signals.items() if (v := clicks_of(x, RATE))}
    assert want and places(chunked(spark, signals, size)) == want


def test_a_scan_sample_by_sample_agrees():
    """The evidence written out again from its definition, with plain loops over the whole signal."""
    for seed in range(3):
        x = noisy(seed, 3000).astype(float)
        r, n, total = Reach(RATE), Reach(RATE).frame, 3000
        many = total // n
        rms = [math.sqrt(sum(v * v for v in x[f * n : f * n + n]) / n) for f in range(many)]
        sharp = []
        for f in range(many):
            w = x[f * n : f * n + n]
            sharp.append(math.sqrt(sum((w[j] - (w[max(0, j - 1)] + w[min(n - 1, j + 1)]) / 2) ** 2 for j in range(n)) / n) + 1e-12)
        near = lambda v, f: max(v[max(0, f - 1)], v[f], v[min(many - 1, f + 1)])
        step = lambda i: x[i] - x[i - 1]
        found = []
        for i in range(1, total - 1):
            f = min(many - 1, i // n)
            d, a, b = step(i), near(rms, f), near(sharp, f)
            floor = max(0.012, a * 1.35, b * 5.5)
            pulse = False
            for j in range(i + 1, min(total - 1, i + r.rest) + 1):
                e = step(j)
                s = min(abs(d), abs(e))
                if abs(d) < floor or d * e >= 0 or abs(e) < floor or abs(x[j] - x[i - 1]) > 0.45 * s + 0.2 * a:
                    continue
                around = [abs(step(k)) for k in range(max(1, i - r.around_pulse), min(total - 1, j + r.around_pulse) + 1) if not i - 2 <= k <= j + 2]
                pulse |= s >= max(around, default=0) * (2.8 + (j - i) / r.rest * 1.2)
            edge = False
            if abs(d) >= max(0.012, b * 5.5):
                close = [abs(step(k)) for k in range(max(1, i - r.around_edge), min(total - 1, i + r.around_edge) + 1) if abs(k - i) > r.core]
                alone = abs(d) >= 4 * max(close, default=0)
                lo, hi = i - r.core - r.far, i + r.core
                if not alone and lo >= 0 and hi + r.far <= total:
                    alone = abs(sum(x[hi : hi + r.far]) / r.far - sum(x[lo : lo + r.far]) / r.far) >= max(0.012, 0.35 * abs(d))
                like = [step(k) * d for k in range(max(1, i - r.far), min(total - 1, i + r.far) + 1) if abs(k - i) > r.around_edge and abs(step(k)) >= 0.75 * abs(d)]
                whole = Stretch(x, 0, total, r)
                edge = alone and len(like) < 2 and not any(v > 0 for v in like) or (whole.narrow(i, i, d) and whole.seam(i))
            if pulse or edge:
                found.append(i)
        assert clicks.rested(found, r.rest) == clicks_of(x, RATE) != []


def test_awkward_series(spark):
    rows = [
        (1, 0, None), (2, 0, []), (3, 0, [0.5]), (4, 0, [0.0, 0.9, 0.0]), (None, 0, tone(800).tolist()), (5, 0, [float("nan")] * 400), (5, 1, [0.0] * 50 + [0.9] + [0.0] * 349),
    ]
    df = spark.createDataFrame(rows, "series int, chunk int, samples array<float>")
    got = {r["series"]: r["clicks"] for r in click_counts(df, ["series"], RATE).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, None: 0, 5: 1}
    assert click_counts(df.limit(0), ["series"], RATE).collect() == []
