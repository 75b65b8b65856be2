"""Protected speech against a scan frame by frame, and reports that do not fit the planner's grid."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from cadenza.operators import protection

MS = 20.0


def scan(energy, p, gap=13, short=8):
    model = [not e and v is not None and v >= 0.58 for e, v in zip(energy, p)]
    added, alone, i = set(), set(), 0
    while i < len(energy):
        if not model[i]:
            i += 1
            continue
        j = i
        while j < len(energy) and model[j]:
            j += 1
        left, right = i > 0 and energy[i - 1], j < len(energy) and energy[j]
        good = j - i <= gap if left and right else (left or right) and j - i <= short and all(v >= 0.72 for v in p[i:j])
        (added if good else alone).update(range(i, j))
        i = j
    return added, alone


def test_runs_of_the_model_alone(spark):
    rng, rows, want = random.Random(3), [], {}
    for k in range(30):
        n, energy, p, e, v = rng.randint(1, 90), [], [], False, 0.2
        for _ in range(n):
            e = e if rng.random() < 0.85 else not e
            v = v if rng.random() < 0.8 else rng.choice([0.1, 0.57, 0.58, 0.65, 0.72, 0.9, None])
            energy.append(e), p.append(v)
        rows += [(k, i, e, v) for i, (e, v) in enumerate(zip(energy, p))]
        want[k] = scan(energy, p)
    d = spark.createDataFrame(rows, "k int, frame_idx long, energy boolean, probability double")
    out = protection.protect(d, ["k"], MS).cache()
    for k, (added, alone) in want.items():
        mine = out.where(F.col("k") == k).collect()
        assert {r["frame_idx"] for r in mine if r["added"]} == added and {r["frame_idx"] for r in mine if r["isolated"]} == alone
        assert all(r["protected"] == (r["energy"] or r["added"]) for r in mine)
    for r in protection.ranges(out, ["k"]).collect():
        added, alone = want[r["k"]]
        assert (r["reason"], r["added"], r["isolated"]) == (("ml-protection", len(added), len(alone)) if added else ("legacy-fallback", 0, 0))


def test_reports_that_do_not_fit(spark):
    """One frame off the grid, a hole, a probability over one, another cadence, a range beyond the report, or off its grid."""
    kinds = ["good", "late", "hole", "over", "cadence", "short", "between", "none"]
    mask, report, reports = [], [], []
    for k, kind in enumerate(kinds):
        start = 0.1 + (0.01 if kind == "between" else 0.0)
        mask += [(k, start, i, False) for i in range(10)]
        if kind == "none":
            continue
        n = 12 if kind == "short" else 20
        reports.append((k, 10.0 if kind == "cadence" else MS, n, n * MS))
        for f in range(n):
            if kind == "hole" and f == 9:
                continue
            at = f * MS + (5.1 if kind == "late" and f == 9 else 5.0)
            report.append((k, f, at, (f + 1) * MS, 1.5 if kind == "over" and f == 9 else 0.9))
    d = protection.planner_frames(
        spark.createDataFrame(mask, "k int, range_start_sec double, frame_idx long, energy boolean"), spark.createDataFrame(report, "k int, frame long, start_ms double, end_ms double, probability double"),
        spark.createDataFrame(reports, "k int, frame_ms double, frames long, duration_ms double"), ["k"], MS,
    )
    got = {r["k"]: (r["n"], r["m"]) for r in d.groupBy("k").agg(F.count("*").alias("n"), F.count("probability").alias("m")).collect()}
    assert got == {k: (10, 10 if kind == "good" else 0) for k, kind in enumerate(kinds)}
