"""Corrections of gains against plain loops over lists."""

from __future__ import annotations

import math
import random

import pytest

from cadenza.operators import painting

HIGH = 12.0


def series(seed, n=500):
    """Frames (level, gain, speech): waves, fades that rise and fall, holes, a loud event, and missing values."""
    rng, out = random.Random(seed), []
    for i in range(n):
        speech = not (60 <= i < 75 or 200 <= i < 201 or 330 <= i < 340 or i == 342)
        level = -40 + 14 * math.sin(i / 60) + rng.uniform(-2, 2) + (18 if 120 <= i < 126 else 0)
        if 201 <= i < 330:
            level = (-55 + 0.25 * (i - 201)) if seed % 2 else (-20 - 0.25 * (i - 201))
        if i > 342:
            level = -30 - 0.1 * (i - 342) + (math.nan if i == 470 else 0)
        gain = 6 * math.sin(i / 25) + rng.uniform(-1, 3) - (4 if 30 <= i < 34 else 0)
        out.append((level, None if i == 280 else gain, speech))
    return out


SERIES = {1: series(1), 2: series(2), 3: [(-30.0, 5.0, True)], 4: [(-30.0, 5.0, False)] * 3, 5: [(-25.0 + k, 8.0, True) for k in range(7)]}


def frame(spark):
    rows = [(k, i, *v, "x") for k, s in SERIES.items() for i, v in enumerate(s)]
    return spark.createDataFrame(rows, "k int, frame_idx long, db double, plan double, speech boolean, gain_note string")


def found(d):
    out = {}
    for r in d.orderBy("k", "frame_idx").collect():
        out.setdefault(r["k"], []).append(r["fixed"])
    return out


def spans(s):
    at = 0
    while at < len(s):
        end = at
        while end < len(s) and s[end][2] == s[at][2]:
            end += 1
        if s[at][2]:
            yield at, end
        at = end


def ok(*xs):
    return all(x is not None and math.isfinite(x) for x in xs)


def soft(x, knee):
    return x if x / knee > 40 else knee * math.log1p(math.exp(x / knee))


def ramp(t):
    t = min(1, max(0, t))
    return t * t * (3 - 2 * t)


def nearest(x):
    return math.floor(x + 0.5)


def same(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_valleys(spark):
    def plain(s):
        out = [v[1] for v in s]
        for a, b in spans(s):
            for i in range(a + 14, b - 14):
                sides = [s[i - 14 : i - 5], s[i + 6 : i + 15]]
                if not ok(*s[i][:2], *(x for side in sides for v in side for x in v[:2])):
                    continue
                source = min(sum(v[0] for v in side) / 9 for side in sides)
                made = min(sum(v[0] + v[1] for v in side) / 9 for side in sides)
                dug = made - s[i][0] - s[i][1]
                out[i] += 0.7 * max(0, min(dug, dug - (source - s[i][0])))
        return out

    want = {k: plain(s) for k, s in SERIES.items()}
    same(found(painting.relax_valleys(frame(spark), ["k"], "db", "plan", "speech", out="fixed")), want)
    assert max(w - v[1] for w, v in zip(want[1], SERIES[1]) if v[1] is not None) > 0.5


@pytest.mark.parametrize("target", [-20.0, -38.0])
def test_authority(spark, target):
    def plain(s):
        out = [v[1] for v in s]
        for a, b in spans(s):
            for i in range(a, b):
                if not ok(*s[i][:2]):
                    continue
                near = [(math.cos(abs(j - i) / 13 * math.pi / 2) ** 2, 10 ** (s[j][0] / 10)) for j in range(max(a, i - 12), min(b, i + 13)) if ok(s[j][0])]
                around = 10 * math.log10(sum(w * p for w, p in near) / sum(w for w, _ in near))
                here = s[i][0] + 0.25 * (around - s[i][0])
                up, down = max(0, s[i][1]), min(0, s[i][1])
                excess = soft(up - soft(target + 0.5 - here, 0.35), 0.35)
                out[i] = down + max(0, up - excess * up**4 / (up**4 + 6**4))
        return out

    want = {k: plain(s) for k, s in SERIES.items()}
    same(found(painting.limit_authority(frame(spark), ["k"], "db", "plan", "speech", target, out="fixed")), want)
    assert all(w >= min(0, g[1]) - 1e-9 for k in want for w, g in zip(want[k], SERIES[k]) if g[1] is not None)


def power(s, a, b):
    part = [v[0] for v in s[a:b]]
    return 10 * math.log10(sum(10 ** (x / 10) for x in part) / len(part)) if ok(*part) else None


def trend(s, a, b, floor):
    """The gains of a run by the definition, one step after the other."""
    n, gains = b - a, [v[1] for v in s[a:b]]
    window = max(1, min(10, n // 4))
    half = max(1, window // 2)
    ends = [(max(a, c - half), min(b, c + half + 1)) for c in (a + nearest(n * 0.1), a + nearest(n * 0.9))]
    head, tail = (power(s, *e) for e in ends)
    if n < 2 or head is None or tail is None:
        return gains
    rising, size = tail > head, soft(abs(tail - head), 0.18) - soft(0, 0.18)
    count, last = max(4, min(20, n // window)), None
    moved = {(up, early): 0.0 for up in (True, False) for early in (True, False)}
    for k in range(count):
        c = a + nearest(k / (count - 1) * (n - 1))
        now = power(s, max(a, c - half), min(b, c + half + 1))
        if now is None:
            continue
        if last is not None:
            moved[now > last, (k - 0.5) / (count - 1) <= 0.5] += abs(now - last)
        last = now
    first, second = moved[rising, True], moved[rising, False]
    spent = (first + second) / (sum(moved.values()) + 0.18) * min(1, 2 * min(first, second) / (first + second + 0.18))
    share = (0.12 + 0.16 * (0.5 + 0.5 * math.tanh((size - 9) / 4))) * spent
    mean = [sum(v) / len(v) if (v := [s[i][1] for i in range(*e) if ok(s[i][1])]) else 0 for e in ends]
    now = mean[0] - mean[1] if rising else mean[1] - mean[0]
    wanted = min(3.2, soft(min(size * share, size * 0.28) - now, 0.18) * spent)
    if size <= 0 or wanted <= 0:
        return gains
    apart = max(0.1, ramp(nearest(n * 0.9) / max(1, n - 1)) - ramp(nearest(n * 0.1) / max(1, n - 1)))
    most = min(3.2, wanted / apart)
    for i in range(n):
        if ok(*s[a + i][:2]):
            along = ramp(i / max(1, n - 1))
            gains[i] = min(HIGH, gains[i] + most * (1 - along if rising else along) / (1 + math.exp(-(s[a + i][0] - floor - 8) / 4)))
    return gains


def test_trends(spark):
    from pyspark.sql import functions as F

    want = {}
    for k, s in SERIES.items():
        want[k] = [v[1] for v in s]
        for a, b in spans(s):
            want[k][a:b] = trend(s, a, b, -60.0)
    d = painting.balance_trends(frame(spark).withColumn("floor", F.lit(-60.0)), ["k"], "db", "plan", "speech", "floor", HIGH, out="fixed")
    same(found(d), want)
    assert want[1][205] > SERIES[1][205][1] + 0.5 and want[2][325] > SERIES[2][325][1] + 0.5


def test_recurrent_valleys(spark):
    rng = random.Random(7)
    level = lambda i: -30 + rng.uniform(-1, 1) - (9 if i % 70 < 8 else 0)
    made = {1: [(level(i), 2 + math.sin(i / 30), i not in (300, 301, 340)) for i in range(420)], 2: [(level(i), None if i == 5 else 1.0, True) for i in range(90)], 3: [(-30.0, 11.0, True)] * 48}
    rows = [(k, i, *v, v[0] + math.sin(i)) for k, s in made.items() for i, v in enumerate(s)]
    d = spark.createDataFrame(rows, "k int, frame_idx long, db double, plan double, speech boolean, voice double")

    def plain(s):
        gains, voice = [v[1] for v in s], [v[0] + math.sin(i) for i, v in enumerate(s)]
        if not ok(*gains):
            return gains
        for a, b in spans(s):
            if b - a <= 48:
                continue
            lift, weight = [0.0] * (b - a), 0.0
            for i in range(a + 24, b - 24):
                depths = []
                for x in ([v[0] for v in s], voice):
                    mean = lambda p, q: sum(x[p:q]) / (q - p)  # noqa: B023, E731
                    depths.append(min(mean(i - 24, i - 9), mean(i + 10, i + 25)) - mean(i - 2, i + 3))
                depth = max(0, soft(min(depths), 0.5) - soft(0, 0.5))
                weight += ramp((depth - 0.75) / 5.25)
                lift[i - a] = min(4, depth * 0.6)
            lift = [x * weight / (weight + (b - a) * 0.04) for x in lift]
            for i in range(1, b - a):
                lift[i] = max(lift[i], lift[i - 1] - 0.24)
            for i in range(b - a - 2, -1, -1):
                lift[i] = max(lift[i], lift[i + 1] - 0.24)
            gains[a:b] = [min(HIGH, g + x) for g, x in zip(gains[a:b], lift)]
        return gains

    want = {k: plain(s) for k, s in made.items()}
    same(found(painting.recover_valleys(d, ["k"], "db", "voice", "plan", "speech", HIGH, out="fixed")), want)
    assert max(w - v[1] for w, v in zip(want[1], made[1])) > 1


def hold(x):
    n = len(x)
    return [min([x[j] + 0.24 * abs(i - j) for j in range(n)] + [0.24 * (i + 1), 0.24 * (n - i)]) for i in range(n)]


def crests(x, hint):
    if len(x) <= 80:
        return x
    for _ in range(2):
        was = x
        x = [min(v, (sum(was[i - 40 : i - 6]) + sum(was[i + 7 : i + 41])) / 68 + 1.18 + 0.22 * hint) if 40 <= i < len(was) - 40 else v for i, v in enumerate(was)]
        x = hold(x)
    return x


def test_crests(spark):
    rng = random.Random(3)
    made = {1: [3 * math.sin(i / 9) ** 2 + rng.uniform(0, 1) for i in range(200)], 2: [2.0] * 80, 3: [2.0] * 81, 4: [1.5]}
    d = spark.createDataFrame([(k, i, v) for k, s in made.items() for i, v in enumerate(s)], "k int, frame_idx long, fixed double")
    same(found(painting.flatten_crests(d, ["k"], "fixed", 0.3)), {k: crests(s, 0.3) for k, s in made.items()})


def words(s, a, b, voice, floor, hint):
    """The lifts of a run by the definition."""
    n = b - a
    over = lambda v: soft(v, 0.6) - soft(0, 0.6) if v > 0 else 0.0
    mean = lambda x, i: 10 * math.log10(sum(10 ** (v / 10) for v in x[max(0, i - 15) : i + 16]) / len(x[max(0, i - 15) : i + 16]))
    rank = lambda x, p: sorted(x)[nearest(p * (len(x) - 1))]
    raw, own = [v[0] for v in s[a:b]], voice[a:b]
    made = [o + v[1] for o, v in zip(own, s[a:b])]
    ls, lb, lo = ([mean(x, i) for i in range(n)] for x in (raw, own, made))
    lift, on = [0.0] * n, []
    for i in range(n):
        on.append(rank(raw, 0.7) > raw[i] and rank(own, 0.7) > own[i])
        low = min(over(rank(ls, 0.7) - ls[i]), over(rank(lb, 0.7) - lb[i]))
        if low > 0:
            left = over(min(3.6, low * 0.62) - (low - over(rank(lo, 0.7) - lo[i])))
            lift[i] = min(3.6, left) / (1 + math.exp(-(lb[i] - floor - 8) / 4)) * (1 - 0.6 * ramp((ls[i] - lb[i] - 6) / 6))
    units, i = [], 0
    while i < n:
        j = i
        while j < n and on[j] == on[i]:
            j += 1
        if on[i]:
            ms = (j - i) * 10
            units.append((i, j, ramp(ms / 300) ** 4 * (1 - 0.75 * ramp((ms - 1000) / 800))))
        i = j
    weights = [sum(lift[i:j]) * w for i, j, w in units]
    again = ramp((1 - max(weights) / sum(weights)) / 0.5) if sum(weights) > 0 else 0
    spread = rank(lb, 0.9) - rank(lb, 0.1)
    again *= (0.68 + 0.29 * hint) / (1 + math.exp(-(spread - 5) / 2)) * (1 - 0.12 * ramp((spread - 12) / 8))
    part = [0.0] * n
    for i, j, w in units:
        part[i:j] = [x * w * again for x in lift[i:j]]
    return crests([max(part[j] - 0.24 * abs(i - j) for j in range(n)) for i in range(n)], hint)


def test_words(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    level = lambda i: -25 + rng.uniform(-1, 1) - (11 if i % 90 < 35 else 0)
    made = {1: [(level(i), math.sin(i / 30), i not in (300, 330)) for i in range(420)], 2: [(level(i), None if i == 5 else 1.0, True) for i in range(90)], 3: [(-30.0 + i % 5, 11.0, True) for i in range(29)], 4: [(-25.0 - (12 if 60 <= i < 95 else 0), 0.0, True) for i in range(160)]}
    voice = {k: [v[0] + math.sin(i) for i, v in enumerate(s)] for k, s in made.items()}
    rows = [(k, i, *v, voice[k][i]) for k, s in made.items() for i, v in enumerate(s)]
    d = spark.createDataFrame(rows, "k int, frame_idx long, db double, plan double, speech boolean, voice double").withColumn("floor", F.lit(-60.0))
    want = {}
    for k, s in made.items():
        want[k] = [v[1] for v in s]
        for a, b in spans(s):
            if b - a >= 30 and ok(*(v[1] for v in s[a:b])):
                want[k][a:b] = [min(HIGH, v[1] + x) for v, x in zip(s[a:b], words(s, a, b, voice[k], -60.0, 0.4))]
    same(found(painting.stabilize_words(d, ["k"], "db", "voice", "plan", "speech", "floor", HIGH, 0.4, out="fixed")), want)
    assert max(w - v[1] for w, v in zip(want[1], made[1])) > 0.5


def test_edges(spark):
    rng = random.Random(9)
    made = {1: [(rng.uniform(-1, 1), rng.uniform(-2, 4), i not in (50, 51)) for i in range(120)], 2: [(0.0, 5.0, True)], 3: [(0.0, None if i == 3 else 5.0 * (i % 2), True) for i in range(9)]}
    d = spark.createDataFrame([(k, i, *v) for k, s in made.items() for i, v in enumerate(s)], "k int, frame_idx long, old double, new double, speech boolean")
    want = {}
    for k, s in made.items():
        want[k] = x = [v[1] for v in s]
        for a, b in spans(s):
            if ok(*x[a:b]):
                step = lambda i: max(0.24, abs(s[i][0] - s[i - 1][0]))  # noqa: B023, E731
                for i in range(a + 1, b):
                    x[i] = min(x[i], x[i - 1] + step(i))
                for i in range(b - 2, a - 1, -1):
                    x[i] = min(x[i], x[i + 1] + step(i + 1))
    same(found(painting.keep_edges(d, ["k"], "old", "new", "speech", out="fixed")), want)


def test_no_rows(spark):
    from pyspark.sql import functions as F

    d = frame(spark).where("k > 9")
    assert painting.relax_valleys(d, ["k"], "db", "plan", "speech").count() == 0
    assert painting.balance_trends(d.withColumn("floor", F.lit(0.0)), ["k"], "db", "plan", "speech", "floor", HIGH).count() == 0
