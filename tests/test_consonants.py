"""Frames at a signal's own rate, bodies and caps against plain loops."""

from __future__ import annotations

import math
import random

import pytest

from cadenza.operators import consonants

RATE = 44100.0


def cut(x, sizes, context=0):
    """Chunks of the given sizes in turn: (start, samples, own_start, own_end), with context samples at both sides."""
    out, at, k = [], 0, 0
    while at < len(x):
        end = min(len(x), at + sizes[k % len(sizes)])
        a, b = max(0, at - context), min(len(x), end + context)
        out.append((a, x[a:b], at, end))
        at, k = end, k + 1
    return out


def plain(x, step):
    out, k = [], 0
    while math.floor(k * step + 0.5) < len(x):
        part = x[math.floor(k * step + 0.5) : math.floor((k + 1) * step + 0.5)]
        db = lambda v: 20 * math.log10(v) if v > 0 else -120.0
        out.append((k, len(part), db(math.sqrt(sum(v * v for v in part) / len(part))), db(max(map(abs, part)))))
        k += 1
    return out


@pytest.mark.parametrize(("sizes", "context"), [([3000], 0), ([1, 7, 500], 0), ([88, 89], 25), ([641], 100)])
def test_frames_do_not_depend_on_chunks(spark, sizes, context):
    rng = random.Random(1)
    x = [rng.uniform(-0.5, 0.5) for _ in range(2500)] + [0.0] * 300 + [0.1] * 37
    rows = [(1, *c) for c in cut(x, sizes, context)] + [(2, 0, [0.5], 0, 1), (3, 0, [], 0, 0)]
    d = spark.createDataFrame(rows, "k int, start long, samples array<double>, a long, b long")
    assert consonants.refusals(d.where("k = 1"), ["k"], len(x), own_start="a", own_end="b").count() == 0
    got: dict = {}
    for r in consonants.native_frames(d, ["k"], RATE, own_start="a", own_end="b").orderBy("k", "frame_idx").collect():
        got.setdefault(r["k"], []).append(tuple(r)[1:])
    want = plain(x, RATE * 0.002)
    assert [g[:2] for g in got[1]] == [w[:2] for w in want]
    assert [v for g in got[1] for v in g[2:]] == pytest.approx([v for w in want for v in w[2:]])
    assert [g[:2] for g in got[2]] == [(0, 1)] and 3 not in got


def test_refusals(spark):
    rows = [("fine", 0, 5, 0, 5), ("fine", 5, 5, 5, 10), ("gap", 0, 4, 0, 4), ("gap", 5, 5, 5, 10), ("overlap", 0, 6, 0, 6), ("overlap", 5, 5, 5, 10)]
    rows += [("beyond", 0, 12, 0, 12), ("short", 0, 9, 0, 9), ("bounds", 2, 8, 1, 10), ("bounds", 0, 1, None, 1)]
    d = spark.createDataFrame([(k, s, [0.0] * n, a, b) for k, s, n, a, b in rows], "k string, start long, samples array<double>, a long, b long")
    got = {(r["k"], r["refusal"]) for r in consonants.refusals(d, ["k"], 10, own_start="a", own_end="b").collect()}
    assert {g for g in got if g[0] == g[1]} == {(k, k) for k in ("gap", "overlap", "beyond", "short", "bounds")}
    assert "fine" not in {g[0] for g in got}


def test_frame_without_a_sample(spark):
    d = spark.createDataFrame([(1, 0, [0.0])], "k int, start long, samples array<double>")
    with pytest.raises(ValueError):
        consonants.native_frames(d, ["k"], 100.0)


SERIES = {1: [random.Random(4).uniform(-70, -10) if i % 9 else None for i in range(150)], 2: [-90.0] * 4, 3: [-20.0], 4: [-60.0, -57.0, -30.0, -80.0, -50.0]}


def test_bodies(spark):
    d = spark.createDataFrame([(k, i, v) for k, s in SERIES.items() for i, v in enumerate(s)], "k int, frame_idx long, db double")
    got = {(r["k"], r["frame_idx"]): r["body"] for r in d.select("k", "frame_idx", consonants.local_body("db", ["k"], 12).alias("body")).collect()}
    for k, s in SERIES.items():
        for i, own in enumerate(s):
            near = sorted(v for v in s[max(0, i - 12) : i + 13] if v is not None and v >= -58)
            want = near[: max(1, math.ceil(len(near) * 0.72))][math.floor(max(1, math.ceil(len(near) * 0.72)) * 0.6)] if near else -120.0 if own is None else own
            assert got[k, i] == want


def test_caps(spark):
    rng = random.Random(6)
    made = {1: [max(0.0, rng.uniform(-3, 6)) for _ in range(200)], 2: [3.0] * 4, 3: [0.0, 0.0, 0.0, 9.0, 0.0, 0.0, 0.0], 4: [5.0] * 9, 5: [1.0, 2.0, 0.0, 2.0, 1.0]}
    d = spark.createDataFrame([(k, i, v) for k, s in made.items() for i, v in enumerate(s)], "k int, frame_idx long, asked double")
    got: dict = {}
    for r in consonants.relax_caps(d, ["k"], "asked").orderBy("k", "frame_idx").collect():
        got.setdefault(r["k"], []).append(r["cap"])
    for k, s in made.items():
        held = list(s)
        if len(s) >= 5:
            for i in range(2, len(s) - 2):
                around = sum(w * v for w, v in zip((1, 2, 3, 2, 1), s[i - 2 : i + 3]))
                held[i] = s[i] * min(1, around / (9 * s[i])) ** 4 if s[i] > 0 else 0.0
            want = list(held)
            for i in range(1, len(s) - 1):
                if s[i] <= 0 < min(s[i - 1], s[i + 1]):
                    want[i] = min(held[i], min(held[i - 1], held[i + 1]) * 0.4)
        else:
            want = held
        assert got[k] == pytest.approx(want), k
    assert got[3][3] < 0.2 and got[4][4] == pytest.approx(5.0)
