"""The comparison of two envelopes against plain loops over lists, at a lag either way."""

from __future__ import annotations

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import envelopes as env

MS, SCHEMA = 20.0, "k int, frame_idx long, frame_db double, peak_db double, body_db double"


def pct(values, p):
    return float(np.quantile(values, p)) if len(values) else None


def made(seed, n=1300):
    """Source and a candidate that starts some frames earlier or later, as lists of (frame, peak, body)."""
    rng = random.Random(seed)
    source, level = [], -30.0
    for i in range(n):
        level += rng.uniform(-2, 2) + (-30 - level) * 0.05
        db = level if (i // 130) % 5 else -75 + rng.random()
        if rng.random() < 0.03:
            db += rng.uniform(5, 12)
        source.append([db, db + rng.uniform(3, 12), db - rng.uniform(1, 4)])
    lag = rng.choice([-7, -3, 0, 4, 9])
    candidate = []
    for i in range(n + rng.randint(-20, 20)):
        s = source[min(n - 1, max(0, i - lag))]
        db = 0.7 * s[0] - 6 + rng.uniform(-0.5, 0.5) + (rng.uniform(3, 6) if rng.random() < 0.02 else 0)
        candidate.append([db, db + rng.uniform(3, 9), db - rng.uniform(1, 3)])
    for _ in range(12):
        source[rng.randrange(n)][rng.randrange(3)] = rng.choice([math.nan, math.inf])
    return source, candidate


def mask(values):
    return [math.isfinite(v) and v > -60 for v in values]


def spoken(d):
    return d.withColumn("active", F.col("frame_db") > -60)


def supported(body, speech):
    heard = [b for b, s in zip(body, speech) if s and math.isfinite(b)]
    if len(heard) < 20:
        return speech
    return [s and math.isfinite(b) and b >= median(heard) - 24 for b, s in zip(body, speech)]


def plain(source, candidate):
    """alignment, contrasts by domain, up and down spikes, expressive frames, spreads, arcs, sections: all by loops."""
    sup = supported([s[2] for s in source], mask([s[0] for s in source]))

    def error(lag):
        d = [candidate[i + lag][0] - s[0] for i, s in enumerate(source) if sup[i] and 0 <= i + lag < len(candidate) and math.isfinite(s[0]) and math.isfinite(candidate[i + lag][0])]
        return median(abs(x - median(d)) for x in d) if len(d) >= 20 else None

    zero = best = error(0)
    lag = 0
    for k in [k for k in range(-12, 13) if k]:
        e = error(k)
        if e is not None and (e < best - 0.05 or abs(e - best) <= 1e-9 and abs(k) < abs(lag)):
            lag, best = k, e
    start = max(0, -lag)
    n = min(len(source) - start, len(candidate) - max(0, lag))
    s, c = source[start : start + n], candidate[max(0, lag) : max(0, lag) + n]
    speech = mask([x[0] for x in s])
    sup = supported([x[2] for x in s], speech)
    found = {}
    for domain, at in (("frame", 0), ("body", 2)):
        out = {}
        for i in range(20, n - 20):
            if not sup[i] or not math.isfinite(s[i][at]) or not math.isfinite(c[i][at]):
                continue
            sides = [[[x[j][at] for j in span if sup[j] and math.isfinite(x[j][at])] for span in (range(i - 20, i - 3), range(i + 4, i + 21))] for x in (s, c)]
            if min(len(v) for pair in sides for v in pair) >= 4:
                mean = [sum(sum(v) / len(v) for v in pair) / 2 for pair in sides]
                crest = lambda x: x[i][1] - x[i][0] if at == 0 and math.isfinite(x[i][1]) else None  # noqa: E731, B023
                out[i] = s[i][at] - mean[0], c[i][at] - mean[1], crest(s), crest(c)
        found[domain] = out
    one = found["frame"]
    spikes = {}
    for domain, items in found.items():
        for name, sign in (("up", 1), ("down", -1)):
            added = {i: max(0.0, sign * v[1] - max(sign * items[j][0] for j in (i - 1, i, i + 1) if j in items)) for i, v in items.items()}
            groups: list = []
            for i in sorted(i for i, a in added.items() if a >= 1.5):
                if groups and i - groups[-1][-1] <= 5:
                    groups[-1].append(i)
                else:
                    groups.append([i])
            spikes[domain, name] = sorted((round((start + g[0]) * 0.02, 6), round((start + g[-1] + 1) * 0.02, 6), round(max(added[i] for i in g), 6)) for g in groups)
    t = max(2.5, pct([v[0] for v in one.values() if v[0] > 0], 0.9) or 2.5)
    u = max(6.0, pct([v[2] for v in one.values() if v[2] is not None], 0.9) or 6.0)
    loud = {i for i, v in one.items() if v[0] >= t or (v[0] >= 1.25 and v[2] is not None and v[2] >= u)}
    return {"lag": lag, "improvement": max(0.0, zero - best), "n": n, "s": s, "c": c, "speech": speech, "sup": sup, "contrasts": found, "spikes": spikes, "loud": loud}


def runs_of(flags):
    out, at = [], None
    for i, f in enumerate([*flags, False]):
        if f and at is None:
            at = i
        elif not f and at is not None:
            out.append((at, i))
            at = None
    return out


def windows_of(p, flags, expressive):
    for a, b in runs_of(flags):
        found = []
        for i in range(a, b - 14, 5):
            pair = [(p["s"][j][2], p["c"][j][2]) for j in range(i, i + 15) if p["sup"][j] and math.isfinite(p["s"][j][2]) and math.isfinite(p["c"][j][2])]
            if len(pair) >= 12 and not (expressive and any(j in p["loud"] for j in range(i, i + 15))):
                found.append((median(x for x, _ in pair), median(y for _, y in pair)))
        yield found


@pytest.fixture(scope="module")
def both(spark):
    series = {k: made(k) for k in range(5)}
    rows = [[(k, i, *x) for k, pair in series.items() for i, x in enumerate(pair[side])] for side in (0, 1)]
    source, candidate = (spark.createDataFrame(r, SCHEMA).cache() for r in rows)
    frames, lags = env.aligned(source, candidate, ["k"], MS, spoken)
    frames = frames.cache()
    loud = env.expressive(env.contrasts(frames, ["k"], MS, "frame"), ["k"], MS).cache()
    return {k: plain(*p) for k, p in series.items()}, frames, lags, loud


def near(a, b):
    assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-6), (a, b)


def test_alignment_and_frames(both):
    want, frames, lags, _ = both
    got = {r["k"]: r for r in lags.collect()}
    assert {p["lag"] for p in want.values()} != {0}
    for k, p in want.items():
        assert got[k]["lag"] == p["lag"]
        near(got[k]["improvement"], p["improvement"])
        mine = frames.where(F.col("k") == k).orderBy("frame_idx").collect()
        assert [r["frame_idx"] for r in mine] == list(range(p["n"]))
        assert [r["support"] for r in mine] == p["sup"] and {r["offset"] for r in mine} == {max(0, -p["lag"])}


def test_contrasts_spikes_and_expressive_frames(both):
    want, frames, _, loud = both
    for domain in ("frame", "body"):
        found = env.contrasts(frames, ["k"], MS, domain).cache()
        events = env.spike_events(found, ["k"], MS).collect()
        for k, p in want.items():
            mine = {r["frame_idx"]: r for r in found.where(F.col("k") == k).collect()}
            assert set(mine) == set(p["contrasts"][domain])
            for i, v in p["contrasts"][domain].items():
                for name, x in zip(("s_contrast", "c_contrast", "s_crest", "c_crest"), v):
                    near(mine[i][name], x)
            for direction in ("up", "down"):
                assert sorted((e["start_sec"], e["end_sec"], round(e["peak"], 6)) for e in events if (e["k"], e["direction"]) == (k, direction)) == p["spikes"][domain, direction]
    for k, p in want.items():
        assert {r["frame_idx"] for r in loud.where((F.col("k") == k) & F.col("event").isNotNull()).collect()} == p["loud"]


def test_body_runs_and_arcs(both):
    want, frames, _, loud = both
    body = {r["k"]: r for r in env.body(frames, loud, ["k"]).collect()}
    spreads, arcs = env.run_spreads(frames, loud, ["k"], MS).collect(), env.run_arcs(frames, loud, ["k"], MS).collect()
    for k, p in want.items():
        used = [(s, c) for i, (s, c) in enumerate(zip(p["s"], p["c"])) if p["sup"][i] and i not in p["loud"] and all(map(math.isfinite, (s[0], s[2], c[0], c[2])))]
        assert body[k]["body_frames"] == len(used)
        s, c = [x[2] for x, _ in used], [y[2] for _, y in used]
        near(body[k]["s_floor"], pct(s, 0.1) - median(s))
        near(body[k]["spread_delta"], pct(c, 0.9) - pct(c, 0.1) - pct(s, 0.9) + pct(s, 0.1))
        near(body[k]["balance_delta"], median(y[2] - y[0] for _, y in used) - median(x[2] - x[0] for x, _ in used))
        middle = median(x[2] for i, x in enumerate(p["s"]) if p["sup"][i] and math.isfinite(x[2]))
        kept = [[w for w in run if w[0] >= middle - 18] for run in windows_of(p, p["speech"], True)]
        expected = sorted(pct([w[0] for w in run], 0.9) - pct([w[0] for w in run], 0.1) for run in kept if len(run) >= 5)
        assert sorted(r["s_spread"] for r in spreads if r["k"] == k) == pytest.approx(expected)
        held = [p["speech"][i] and p["sup"][i] and math.isfinite(p["c"][i][2]) and p["s"][i][2] >= middle - 24 for i in range(p["n"])]
        expected = []
        for run in windows_of(p, held, False):
            n, e = len(run), max(1, math.floor(len(run) * 0.2 + 0.5))
            if n >= 5 and n > 2 * e:
                for side in (0, 1):
                    v = [w[side] for w in run]
                    expected.append((max(v[e : n - e]) - median(v[:e]), max(v[e : n - e]) - median(v[n - e :])))
        got = sorted((r[f"{x}_rise"], r[f"{x}_fall"]) for r in arcs if r["k"] == k for x in "sc")
        assert got == [pytest.approx(x) for x in sorted(expected)] and expected


def test_sections_and_drift(both):
    want, frames, *_ = both
    sections = env.sections(frames, ["k"], MS)
    found, drift = sections.collect(), {r["k"]: r for r in env.drift(sections, ["k"]).collect()}
    for k, p in want.items():
        rows = []
        for a in range(0, p["n"], 500):
            pair = [(p["s"][i][0], p["c"][i][0]) for i in range(a, min(p["n"], a + 500)) if p["speech"][i] and math.isfinite(p["c"][i][0])]
            if len(pair) >= 5:
                rows.append(((a + min(p["n"], a + 500)) * 0.01, median(x for x, _ in pair), median(y for _, y in pair), median(y - x for x, y in pair)))
        assert sorted((r["mid_sec"], r["s_level"], r["c_level"], r["delta"]) for r in found if r["k"] == k) == [pytest.approx(x) for x in rows]
        least = 2 if len(rows) >= 3 else 1
        slopes = [(b[3] - a[3]) / ((b[0] - a[0]) / 60) for i, a in enumerate(rows) for b in rows[i + least : i + 7]]
        near(drift[k]["slope"], median(slopes) if slopes else None)
        near(drift[k]["rising"], max(0.0, pct(slopes, 0.75)) if slopes else None)


def test_too_little_evidence(spark):
    rows = [(1, i, -20.0 - i, -10.0, -22.0) for i in range(10)]
    frames, lags = env.aligned(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(rows[:7], SCHEMA), ["k"], MS, spoken)
    assert [tuple(r) for r in lags.collect()] == [(1, 0, None)] and frames.count() == 7
    loud = env.expressive(env.contrasts(frames, ["k"], MS, "frame"), ["k"], MS)
    assert loud.count() == 0 and env.run_arcs(frames, loud, ["k"], MS).count() == 0
    (b,) = env.body(frames, loud, ["k"]).collect()
    assert b["body_frames"] == 7 and b["s_floor"] is None
    none = spark.createDataFrame([], SCHEMA)
    assert env.aligned(none, none, ["k"], MS, spoken)[0].count() == 0


@pytest.mark.parametrize("grain", [1e-6, 0.5])
def test_every_frame_of_long_series_counts(spark, grain):
    """Over 40,000 frames: the error is that of all pairs, not of every n-th, also where many differences are equal."""
    n, late = 45_000, 3
    rng = np.random.default_rng(7)
    level = np.round(rng.normal(-30, 6, n) / grain) * grain
    after = np.round((0.7 * np.concatenate([rng.normal(-30, 6, late), level]) + rng.normal(0, 2, n + late)) / grain) * grain
    heard = rng.random(n) < 0.8
    source = spark.createDataFrame([(1, i, float(x), bool(s)) for i, (x, s) in enumerate(zip(level, heard))], "k int, frame_idx long, frame_db double, support boolean")
    candidate = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(after)], "k int, frame_idx long, frame_db double")

    def error(lag):
        d = (after[late * (lag > 0) : n + late * (lag > 0)] - level)[heard]
        return np.median(np.abs(d - np.median(d)))

    ((_, lag, improvement),) = env.alignment(source, candidate, ["k"], MS).collect()
    assert lag == late and improvement == pytest.approx(error(0) - error(late), abs=1e-12)


def test_long_series_are_paired_by_the_lag_of_all_frames(spark):
    """All measures are taken on these pairs. Every second frame fits best without a lag, more of the others with one of two."""
    n = 41_000
    rng = np.random.default_rng(3)
    i, near = np.arange(n), rng.normal(0, 0.1, n)
    level = np.where((i % 2 == 1) | (rng.random(n) < 0.6), rng.uniform(-45, -15, n), -75.0)
    after = np.where(i % 2 == 0, level, np.roll(level, 2)) + near
    tables = [spark.createDataFrame([(1, k, float(x), float(x) + 3, float(x) - 2) for k, x in enumerate(v)], SCHEMA) for v in (level, after)]
    frames, lags = env.aligned(*tables, ["k"], MS, spoken)
    assert [r["lag"] for r in lags.collect()] == [2]
    close = F.avg((F.abs(F.col("s_frame") - F.col("c_frame")) < 1).cast("int"))
    assert frames.where("speech").agg(close).first()[0] > 0.6
