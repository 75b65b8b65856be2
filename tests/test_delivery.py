"""Delivery levels against written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import delivery as dv

C = F.col
NAN = float("nan")


def test_makeup_and_lane(spark):
    d = spark.createDataFrame([(-20.0, -25.0), (-20.0, -10.0), (-5.0, -40.0), (None, -25.0), (-20.0, NAN)], "t double, m double")
    assert [r[0] for r in d.select(dv.makeup_db(C("t"), C("m"))).collect()] == pytest.approx([6.35, 0.0, 10.5, 0.0, 0.0])
    d = spark.createDataFrame([(4.0, -70.0, 1.0, -62.0, 1.0), (4.0, -70.0, 0.0, -62.0, 1.0), (4.0, -50.0, 1.0, -60.0, 2.0), (4.0, -80.0, 0.25, -50.0, 1.0)], "r double, s double, a double, f double, b double")
    assert [r[0] for r in d.select(dv.noise_lane_db(*map(C, "rsafb"))).collect()] == pytest.approx([2.0, 4.0, 4.0, 2.0])


def test_frame_range(spark):
    rows = [(1.0, 1.0, 10.0, 1000.0), (0.0, 0.5, 10.0, 20.0), (-3.0, 0.1, 10.0, 20.0), (9.0, 1.0, 10.0, 20.5), (0.0, 0.0, 10.0, 20.0), (0.0, 1.0, 0.0, 20.0), (None, 1.0, 10.0, 20.0), (NAN, 1.0, 10.0, 20.0), (0.057, 0.1, 10.0, 50.0)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [tuple(r[0]) for r in d.select(dv.frame_range(*map(C, "abcd"))).collect()]
    assert got[:-1] == [(99, 201, 1.0), (0, 20, 0.0), (0, 11, 0.0), (20, 20, 0.0), (0, 0, 0.0), (0, 0, 0.0), (0, 0, 0.0), (0, 0, 0.0)]
    assert got[-1][:2] == (4, 17) and got[-1][2] == pytest.approx(1.7)


def test_spectrum(spark):
    rows = [([0.0] * 8,), ([3.0] * 3 + [0.0] * 3 + [1.0, 4.0],), ([0.0] * 6 + [4.0, 1.0],), ([0.0] * 7,), ([NAN] + [0.0] * 7,), ([],), (None,)]
    d = spark.createDataFrame(rows, "b array<double>")
    got = d.select(dv.tilts_db(C("b")), dv.de_esser_placement(C("b"))).collect()
    assert [r[1] for r in got][:6] == ["balanced", "high_center", "low_center", "balanced", "balanced", "balanced"]
    assert [r[0] is None for r in got] == [False, False, False, True, True, True, True]
    assert got[1][0]["low"] == pytest.approx(3.0)
    assert set(dv.DE_ESSER) == {"low_center", "balanced", "high_center"}


def test_sizes(spark):
    d = spark.createDataFrame([(1.0, 48000.0), (0.00001, 48000.9), (-1.0, 0.0), (None, NAN)], "s double, r double")
    assert [r[0] for r in d.select(dv.wav_bytes(C("s"), C("r"))).collect()] == [192044, 48, 44, 44]
    d = spark.createDataFrame([(10.0, 1.0, 1.0), (1.0, 10.0, 0.0), (1.0, 6.0, 6.0), (1.0, 1.0, None)], "s double, r double, c double")
    assert [r[0] for r in d.select(dv.needs_windows(*map(C, "src"), 10.0, 10.0, 12.0)).collect()] == [True, True, True, False]
