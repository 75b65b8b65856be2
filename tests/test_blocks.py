"""Steps of long series by blocks give what windows over whole series give, and no window goes over a series."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import percentiles as pct
from cadenza.operators import blocks, echo, frames, painting, runs
from cadenza.operators import quality_report as qr

C, KEYS = F.col, ["k"]


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(3)
    rows = []
    for k, n in ((1, 700), (2, 64), (None, 65), (3, 1)):
        at = 0
        while at < n:
            flag, size = rng.choice([True, False, True, False, None]), rng.choice([1, 2, 3, 5, 8, 9, 40])
            for i in range(at, min(n, at + size)):
                rows.append((k, i, n, flag, rng.uniform(-60, 0), rng.uniform(-9, 9)))
            at += size
    return spark.createDataFrame(rows, "k int, frame_idx long, n long, speech boolean, db double, gain double").repartition(5)


def rows(d, *columns):
    return sorted((tuple(r) for r in d.select("k", "frame_idx", *columns).collect()), key=str)


def test_runs_and_masks(long):
    assert rows(blocks.with_run_id(long, KEYS, "speech", size=32), "run_id") == rows(runs.with_run_id(long, KEYS, "speech"), "run_id")
    for least, gap in ((3, 8), (6, 2), (1, 1)):
        assert rows(blocks.finalize_mask(long, KEYS, "speech", least, gap, "n", size=32), "speech") == rows(runs.finalize_mask(long, KEYS, "speech", least, gap), "speech")


def test_index(spark):
    d = spark.range(5000).select((C("id") % 3).alias("k"), F.xxhash64("id").alias("t"), "id")
    got, want = blocks.indexed(d, KEYS, ["t", "id"]), frames.indexed(d, KEYS, ["t", "id"])
    assert rows(got, "id") == rows(want, "id")


@pytest.mark.parametrize("large", [False, True])
def test_percentiles(spark, long, large):
    if large:
        long = spark.range(45_000).select(F.pmod("id", F.lit(3)).alias("k"), (F.xxhash64("id") / 1e17).alias("db"), F.pmod(F.xxhash64("id"), F.lit(7)).cast("double").alias("gain"))
    ps = (0.0, 0.1, 0.25, 0.5, 0.85, 1.0)
    got = pct.placed(long, KEYS, {f"p{j}": ("db", p) for j, p in enumerate(ps)})
    want = long.groupBy("k").agg(F.count("*").alias("__n"), *(F.percentile("db", F.lit(p)).alias(f"p{j}") for j, p in enumerate(ps)))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    near = pct.placed(long, KEYS, {"a": ("db", 0.7), "b": ("gain", 0.1)}, nearest=True)
    want = long.groupBy("k").agg(F.count("*").alias("__n"), pct.nearest_rank(C("db"), 0.7).alias("a"), pct.nearest_rank(C("gain"), 0.1).alias("b"))
    assert sorted(near.collect(), key=str) == sorted(want.collect(), key=str)


def one_and_many(monkeypatch, made, *columns):
    one = rows(made(), *columns)
    plain = blocks.beside_blocks, blocks.with_run_id, blocks.last_known
    for f in plain:
        monkeypatch.setattr(blocks, f.__name__, lambda *a, f=f, **o: f(*a, **o, size=256))
    many = rows(made(), *columns)
    assert [r[:2] for r in one] == [r[:2] for r in many]
    assert all(a == b or abs(a - b) < 1e-12 for x, y in zip(one, many) for a, b in zip(x[2:], y[2:]))


def test_words_over_blocks(long, monkeypatch):
    d = long.withColumns({"on": F.lit(True), "run": F.lit(0), "floor": F.lit(-50.0), "db": 20 * F.sin(C("frame_idx") / 9) + C("db") / 20, "gain": C("gain") / 9})
    one_and_many(monkeypatch, lambda: painting.stabilize_words(d, KEYS, "db", "db", "gain", "on", "floor", 12.0, run="run", out="out"), "out")


def test_tails_over_blocks(long, monkeypatch):
    d = long.withColumn("speech", F.coalesce("speech", F.lit(False)))

    def made():
        t = echo.finishing_targets(echo.strict_targets(d, KEYS).withColumnRenamed("target", "strict"), KEYS, 10.0)
        t = echo.asymmetric(t, KEYS, "strict", 0.99, 0.68, "a")
        return echo.asymmetric(t, KEYS, "target", 0.3, 0.16, "b")

    one_and_many(monkeypatch, made, "strict", "target", "a", "b")


def test_no_window_over_a_series(long):
    """Frames are never put in order by series; runs are, one row each."""
    d = blocks.with_run_id(long.withColumn("speech", F.coalesce("speech", F.lit(False))), KEYS, "speech")
    for made in (blocks.finalize_mask(d, KEYS, "speech", 3, 8, "n"), painting.relax_valleys(d, KEYS, "db", "gain", "speech", run="run_id"), qr.in_runs(d, KEYS, "speech", "run_id")):
        lines = [x for x in made._jdf.queryExecution().optimizedPlan().toString().splitlines() if "+- Window" in x or x.startswith("Window")]
        assert lines and not [x for x in lines if ", [k#" in x and "frame_idx" in x.split(", [k#")[-1] and "__block" not in x and "run" not in x.split(", [k#")[-1]]
