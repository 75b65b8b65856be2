"""Evidence, echo cleanup, matched levels and comparable metrics against written cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.operators import evidence as ev

C = F.col
NAN = float("nan")


def test_speech_authority(spark):
    rows = [("a", 0, 0.9, 0.0, 4000.0), ("a", 1, 0.5, 2000.0, 3000.0), ("a", 2, 0.4, 0.0, 9000.0), ("a", 3, 0.8, 3500.0, 20000.0), ("b", 0, None, 0.0, 1.0), ("b", 1, NAN, 0.0, 1.0), ("b", 2, 0.7, None, 5.0)]
    d = spark.createDataFrame(rows, "k string, i int, p double, s double, e double").withColumn("whole", F.lit(7000.0))
    got = {r["k"]: r for r in ev.speech_authority(d, ["k"], "i", "p", "s", "e", "whole").collect()}
    assert (got["a"]["speech_share"], got["a"]["speech_seconds"]) == (0.75, 7.0)
    assert got["a"]["share_authority"] == 1.0 and got["a"]["seconds_authority"] == pytest.approx(0.625)
    assert got["b"]["speech_share"] == pytest.approx(1 / 3) and got["b"]["speech_seconds"] == 0.0
    assert ev.speech_authority(d.where("false"), ["k"], "i", "p", "s", "e", "whole").count() == 0


def test_echo(spark):
    rows = [("high", 0.72, 0.0, 30.0), ("high", 0.56, 0.72, 30.0), ("medium", 0.6, 0.82, 30.0), ("low", 1.0, 1.0, 30.0), ("high", NAN, 1.0, 30.0), (None, 0.9, None, None)]
    d = spark.createDataFrame(rows, "risk string, echo double, notch double, delay double")
    yes, zero = F.lit(True), F.lit(0.0)
    d = d.withColumn("e", ev.echo_cleanup(C("risk"), yes, yes, C("echo"), F.lit(0.5), zero, C("notch"), zero, zero))
    got = d.select("e.*", ev.echo_cancel_strength(C("e.severe"), C("echo"), F.lit(1.0), C("delay"), zero).alias("c")).collect()
    assert [tuple(r)[:4] for r in got] == [(True,) * 4, (True, False, True, False), (True, False, True, False)] + [(False,) * 4] * 3
    assert [r["c"] for r in got] == pytest.approx([0.2984, 0, 0, 0, 0, 0])


def test_level_match_and_deltas(spark):
    rows = [("a", -20.0, -18.0), ("a", -23.0, -19.0), ("b", None, -18.0), ("b", -3.0, -16.5), ("c", NAN, 1.0), ("c", 1.0, None)]
    got = ev.level_match(spark.createDataFrame(rows, "k string, s double, i double"), ["k"], "s", "i").collect()
    assert sorted((r["k"], r["metric"], r["trim_db"]) for r in got) == [("a", "speech-k-weighted", -3.0), ("a", "speech-k-weighted", 0.0), ("b", "integrated-loudness", -1.5), ("b", "integrated-loudness", 0.0), ("c", "unavailable", 0.0), ("c", "unavailable", 0.0)]
    schema = "k string, available boolean, value double, higher_is_better boolean"
    a = spark.createDataFrame([("x", True, 1.0, True), ("y", True, 1.0, True), ("z", False, 1.0, True), ("w", True, NAN, True)], schema)
    b = spark.createDataFrame([("x", True, 1.25, True), ("y", True, 1.0, False), ("z", True, 1.0, True), ("w", True, 1.0, True)], schema)
    assert [tuple(r) for r in ev.metric_deltas(a, b, ["k"]).collect()] == [("x", 1.0, 1.25, 0.25, True)]
    d = spark.createDataFrame([(0.8,), (0.5,), (0.0,), (None,)], "v double")
    assert [r[0] for r in d.select(ev.deficit(C("v"), 0.8, 0.2)).collect()] == pytest.approx([0.0, 0.5, 1.0, 0.0])
