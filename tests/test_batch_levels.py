"""Levels of files and groups from windows, and where windows go: written cases."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cadenza.operators import batch_levels as bl

C = F.col
WINDOWS = "k string, n int, speech_db double, plateau_db double, frames long, seconds double, frame_ms double"


def ramp(t):
    t = min(1, max(0, t))
    return t * t * (3 - 2 * t)


def test_files(spark):
    rows = [("timed", 0, -20.0, -18.0, 100, 2.0, None), ("timed", 1, -24.0, -22.0, 100, 6.0, None), ("timed", 2, math.nan, -1.0, 100, 60.0, None)]
    rows += [("by frames", 0, -20.0, -18.0, 100, None, 10.0), ("by frames", 1, -24.0, -22.0, 300, 0.0, 10.0)]
    rows += [("alike", 0, -20.0, -18.0, 100, None, None), ("alike", 1, -24.0, -22.0, 300, 3.0, None)]
    rows += [("no plateau", 0, -30.0, None, 100, 3.0, None), ("silent", 0, None, -20.0, 10, 1.0, None), ("no frames", 0, -30.0, -3.0, 0, 3.0, None)]
    got = {r["k"]: r for r in bl.file_levels(spark.createDataFrame(rows, WINDOWS), ["k"], "n").collect()}
    assert "silent" not in got
    timed = got["timed"]
    assert (timed["level"], timed["frames"], timed["seconds"]) == (-22.0, 200, 8.0)
    # weights 6 of -22 and 2 of -18: midpoints at 0.375 and 0.875, so a quarter of the way up
    assert timed["plateau"] == pytest.approx(-21.0) and timed["authority"] == pytest.approx(ramp(7 / 14)) and timed["vote"] == 0.5
    assert got["by frames"]["seconds"] == 4.0 and got["by frames"]["plateau"] == pytest.approx(-21.0)
    alike = got["alike"]
    assert (alike["seconds"], alike["plateau"], alike["authority"], alike["vote"]) == (0.0, -20.0, 0.0, 0.5)
    assert all(got[k]["plateau"] == -30.0 and got[k]["frames"] == 0 for k in ("no plateau", "no frames"))


def test_groups(spark):
    rows = [("timed", 1, -20.0, -19.0, 1.0, 0.5, 30.0, 10), ("timed", 2, -30.0, -29.0, 0.2, 1.0, 90.0, 10)]
    rows += [("framed", 1, -20.0, -19.0, 1.0, 0.5, 0.0, 10), ("framed", 2, -30.0, -29.0, 0.2, 1.0, 0.0, 30)]
    rows += [("mixed", 1, -20.0, -19.0, 1.0, 0.5, 0.0, 10), ("mixed", 2, -30.0, -29.0, 0.2, 1.0, 5.0, 0), ("mixed", 3, None, -29.0, 0.2, 1.0, 5.0, 0)]
    d = spark.createDataFrame(rows, "g string, n int, level double, plateau double, authority double, vote double, seconds double, frames long")
    got = {r["g"]: r for r in bl.group_levels(d, ["g"], "n").collect()}
    assert got["timed"]["level"] == pytest.approx(-27.5) and got["timed"]["authority"] == 1.0 and got["timed"]["vote"] == 1.0
    assert got["framed"]["level"] == pytest.approx(-27.5) and got["framed"]["authority"] == pytest.approx(0.6) and got["framed"]["vote"] == 0.75
    assert (got["mixed"]["level"], got["mixed"]["plateau"], got["mixed"]["authority"], got["mixed"]["seconds"]) == (-25.0, -19.0, 0.0, 0.0)


def test_where_windows_go(spark):
    d = spark.createDataFrame([(s,) for s in (None, 0.0, math.nan, 180.0, 181.0, 720.0, 721.0, 1000.0, 9000.0)], "s double").select("s", bl.even_windows(C("s")).alias("w"))
    got = [[tuple(w) for w in r["w"]] for r in d.collect()]
    assert got[:4] == [[], [], [], [(0.0, 180.0)]]
    assert [len(w) for w in got[4:]] == [6, 6, 13, 17, 24]
    assert got[4][0] == (0.0, 30.0) and got[4][-1] == (151.0, 30.0) and got[8][-1] == (8985.0, 15.0)
    told = d.where("s >= 180 and not isnan(s)").select(*(bl.enough(C("w"), F.lit(n), C("s")) for n in (0, 1, 4))).collect()
    assert tuple(told[0]) == (False, True, True) and tuple(told[1]) == (False, False, True)
    d = spark.createDataFrame([(-20.0, -10.0, 0.25), (-20.0, None, 0.5), (None, -10.0, 0.5)], "a double, b double, c double")
    assert [r[0] for r in d.select(bl.alignment_level(C("a"), C("b"), C("c"))).collect()] == [-17.5, -20.0, -10.0]
