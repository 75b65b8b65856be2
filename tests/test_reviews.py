"""Broken JSON, shapes of reviews and requests, corrective directives: written cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cadenza.functions import reviews

C = F.col


def values(spark, texts, make):
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("v", reviews.parsed(C("t")))
    return [r[0].asDict(True) if hasattr(r[0], "asDict") else r[0] for r in d.orderBy("i").select(make).collect()]


GOOD = '{"verdict": "risky", "confidence": "0.4567"}'


def test_finding_and_mending(spark):
    texts = [GOOD, f"```json\n{GOOD}\n```", f"```\n{GOOD}```", f"so: {GOOD} done", '{"verdict": "risky",\n "confidence": 0.4567,}', '{"verdict": "risky"\n "confidence": 0.4567}']
    texts += ['{"findings": []\n"verdict": "risky",\n"confidence": 0.4567}', '{"findings": [{}\n{}],\n"verdict": "risky"\n"confidence": 0.4567}']
    got = values(spark, texts, F.struct(reviews.review(C("v"))["verdict"].alias("verdict"), reviews.review(C("v"))["confidence"].alias("confidence")))
    assert got == [{"verdict": "risky", "confidence": 0.457}] * len(texts)


def test_nothing_to_find(spark):
    texts = [None, "", "no json", "[1]", '"x"', '{"a": 1} {"b": 2}', '{"a": ', '{"a": NaN}', '{"a": 1, "a": 2}']
    assert values(spark, texts, reviews.review(C("v"))) == [None] * len(texts)


def test_defaults_and_limits(spark):
    body = {
        "verdict": "splendid", "confidence": True, "summary": 7,
        "perFileProfiles": [3, {"base": "  a\tb ", "adaptiveDirectives": {"warmthDb": 9, "airDb": "-0.5", "levelerBias": None, "deHarshDb": [1]}, "recommendedProfile": {"leveler": "Firm", "roomCleanup": "true", "cinematicColor": True}}, {"fileName": "b.wav", "confidence": 2}],
        "findings": {"issue": "not a list"}, "guardrails": ["x" * 200, "", 4, None, "y"], "adjustments": [{}] * 20,
    }
    (got,) = values(spark, [json.dumps(body)], reviews.review(C("v")))
    assert (got["verdict"], got["confidence"], got["summary"], got["findings"]) == ("adjust", 0.0, "Review completed.", [])
    assert got["guardrails"] == ["x" * 180, "y"]
    assert len(got["adjustments"]) == 8 and got["adjustments"][0] == {"control": "Control", "recommendation": "", "why": "", "risk": "Low"}
    first, second = got["perFileProfiles"]
    assert (first["fileName"], first["base"], first["confidence"]) == ("file-1.wav", "a b", 0.0)
    assert (second["fileName"], second["confidence"]) == ("b.wav", 1.0)
    d = first["adaptiveDirectives"]
    assert (d["warmthDb"], d["airDb"], d["levelerBias"], d["deHarshDb"], d["finalPolishIntensity"]) == (1.8, -0.5, 0.0, 0.0, 0.5)
    p = first["recommendedProfile"]
    assert (p["leveler"], p["roomCleanup"], p["cinematicColor"], p["selectedVariant"]) == ("Firm", False, True, "continuity-safe")


def test_request(spark):
    files = [{"fileName": f"f{i}.wav", "durationSeconds": "12.34567", "source": {"echoScore": 0.5, "bandSpectrumDb": [1, "x", 2.5]}} for i in range(15)]
    files[1] = {"base": "no name"}
    bodies = [{"controls": {"leveler": "Firm", "noiseGuard": True}, "files": files, "reviewStage": "post-render"}, {"controls": {}, "files": []}, {"files": files}, {"controls": {}, "files": [{"fileName": "a", "base": "b"}]}]
    got = values(spark, [json.dumps(b) for b in bodies], reviews.request(C("v")))
    assert got[1] is None and got[2] is None
    assert got[0]["reviewStage"] == "post-render" and got[0]["controls"]["leveler"] == "Firm" and got[0]["controls"]["noiseGuard"] is True and got[0]["controls"]["smartMatchMode"] == "Balanced"
    assert [f["fileName"] for f in got[0]["files"]] == [f"f{i}.wav" for i in range(12) if i != 1]
    one = got[0]["files"][0]
    assert (one["base"], one["durationSeconds"], one["source"]["echoScore"], one["source"]["clickScore"], one["source"]["bandSpectrumDb"]) == ("f0.wav", 12.346, 0.5, None, [1.0, 2.5])
    assert got[3]["reviewStage"] == "source" and got[3]["files"][0]["source"]["bandSpectrumDb"] is None
    d = spark.createDataFrame([(list(range(9)),), ([],)], "x array<int>").select(reviews.chunks_of(C("x")))
    assert [r[0] for r in d.collect()] == [[[0, 1, 2, 3], [4, 5, 6, 7], [8]], None]


def test_corrective(spark):
    tags = [["level_uneven"] * 3 + ["too_compressed"], ["nonsense"], []]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, t array<string>").withColumn("d", reviews.corrective(C("t")))
    got = [(r["d"]["levelerBias"], r["d"]["sagRecoveryBoost"], r["moved"]) for r in d.withColumn("moved", reviews.stands_out(C("d"))).orderBy("i").collect()]
    assert got[0] == (pytest.approx(0.25), pytest.approx(0.7), True) and got[1] == got[2] == (0.0, 0.0, False)


def test_parts_and_profiles(spark):
    part = lambda v, c, names, rails: json.dumps({"verdict": v, "confidence": c, "summary": v, "guardrails": rails, "perFileProfiles": [{"fileName": f, "base": b, "summary": s} for f, b, s in names]})
    rows = [(1, 0, part("ready", 0.5, [("a.wav", "a", "one"), ("b.wav", "b", "two")], ["x", "y"])), (1, 1, part("risky", 0.2, [("c.wav", "a", "three")], ["y", "z"])), (1, 2, "broken"), (2, 0, "broken")]
    d = spark.createDataFrame(rows, "k int, n int, t string").withColumn("v", reviews.parsed(C("t"))).select("k", "n", reviews.review(C("v")).alias("review"))
    (got,) = reviews.merge_chunks(d, ["k"], "n", "review").collect()
    assert (got["verdict"], got["confidence"], got["parts"], got["summary"], got["guardrails"]) == ("risky", 0.35, 2, "ready", ["x", "y", "z"])
    files = spark.createDataFrame([(1, "a.wav", "a"), (1, "b.wav", "nobody"), (1, "d.wav", "d"), (2, "a.wav", "a")], "k int, file_name string, base string")
    found = {(r["k"], r["file_name"]): r["profile"] and r["profile"]["summary"] for r in reviews.matched_profiles(files, d, ["k"], "n", "review").collect()}
    assert found == {(1, "a.wav"): "three", (1, "b.wav"): "two", (1, "d.wav"): None, (2, "a.wav"): None}
