"""Steps that must grow with their input: what plans must not hold, and long series that would take minutes otherwise."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions import reviews
from cadenza.functions import scalar as sc
from cadenza.operators import joins, painting, windows
from cadenza.plans import timelines

C = F.col


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def long_run(spark, n=300):
    i = F.col("id")
    return spark.range(n).select(F.lit(0).alias("series"), i.alias("frame_idx"), (5 * F.sin(i / 9)).alias("gain"), (5 * F.sin(i / 9) + F.cos(i * 2)).alias("other"), F.lit(True).alias("on"))


@pytest.mark.parametrize("made", [
    lambda d: painting.keep_edges(d, ["series"], "gain", "other", "on"),
    lambda d: d.select(painting.spread_lifts(C("gain"), ["series"]), painting.hold_slopes(C("gain"), ["series"])),
    lambda d: painting.flatten_crests(d, ["series"], "gain"),
    lambda d: d.select(windows.active_distance(C("on"), ["series"])),
    lambda d: d.select(windows.slew_majorant("gain", ["series"], 0.1), windows.slew_minorant("gain", ["series"], 0.1)),
])
def test_no_window_to_the_end_from_each_frame(spark, made):
    """Spark works such frames out anew for each row."""
    assert "currentrow$(), unboundedfollowing$()" not in plan(made(long_run(spark)))


def test_words_without_windows_over_frames(spark):
    """A block's frames go through NumPy once a step; windows over them took most of the time."""
    d = long_run(spark, 600).withColumns({"run": F.lit(0), "floor": F.lit(-50.0)})
    assert "Window" not in plan(painting.stabilize_words(d, ["series"], "other", "other", "gain", "on", "floor", 12.0, run="run", out="out"))


def test_stretch_over_three_blocks_is_one(spark):
    """Its parts are added up: alone in its series it gets nothing, beside another as large it gets its share."""
    rows = [("one", b, s, e) for b, s, e in ((0, 1.0, 2), (1, 2.0, 3), (2, 1.5, 1))] + [("two", b, s, e) for b, s, e in ((0, 2.0, 0), (0, 1.0, 2), (1, 1.0, 1))] + [("apart", b, s, e) for b, s, e in ((0, 1.0, 2), (1, 1.0, 2), (1, 0.5, 0))]
    d = spark.createDataFrame(rows, "k string, __block long, __sum double, __edge int")
    again = {r["k"]: r["__again"] for r in painting._recurring(d, ["k"]).collect()}
    t = (1 - 1.0 / 2.5) / 0.5
    assert again["one"] == 0 and again["two"] == 1 and again["apart"] == (1.0 if t >= 1 else t * t * (3 - 2 * t))


def test_kept_edges_of_a_run(spark):
    rows = painting.keep_edges(long_run(spark), ["series"], "gain", "other", "on", out="held").orderBy("frame_idx").collect()
    held = [r["other"] for r in rows]
    step = [max(0.24, abs(b["gain"] - a["gain"])) for a, b in zip(rows, rows[1:])]
    for k in range(1, len(held)):
        held[k] = min(held[k], held[k - 1] + step[k - 1])
    for k in range(len(held) - 2, -1, -1):
        held[k] = min(held[k], held[k + 1] + step[k])
    assert max(abs(a - r["held"]) for a, r in zip(held, rows)) < 1e-9


def test_answers_are_parsed_once_when_merged(spark):
    """A filter on the reviews would be pushed to the source with all the parsing in it."""
    rows = [(1, 2, '{"verdict": "risky", "guardrails": ["b"]}'), (1, 1, '{"verdict": "ready", "guardrails": ["a"]}'), (1, 3, "none"), (2, 1, "none")]
    d = spark.createDataFrame(rows, "k int, at int, answer string").withColumn("v", reviews.parsed(C("answer")))
    d = reviews.merge_chunks(d.select("k", "at", reviews.review(C("v"), *reviews.MERGED).alias("review")), ["k"], "at", "review")
    assert not [line for line in plan(d).splitlines() if "Filter" in line and "RLIKE" in line]
    assert [(r["k"], r["verdict"], r["parts"], r["guardrails"]) for r in d.collect()] == [(1, "risky", 2, ["a", "b"])]


def test_review_of_named_fields(spark):
    d = spark.createDataFrame([('{"verdict": "risky", "confidence": 0.5}',)], "answer string").withColumn("v", reviews.parsed(C("answer")))
    assert d.select(reviews.review(C("v"), "verdict").alias("r")).select("r.*").columns == ["verdict", "confidence"]


def test_sums_do_not_depend_on_how_rows_are_dealt(spark):
    values = [0.1, 0.7, 1e16, 0.3, -1e16, 0.2]
    ways = [values, values[::-1], values[3:] + values[:3]]
    got = {spark.createDataFrame([(v,) for v in way], "x double").repartition(3).agg(sc.ordered_sum(C("x"))).first()[0] for way in ways}
    assert len(got) == 1


def test_span_without_length_comes_before_its_silence(spark, monkeypatch):
    speech = spark.createDataFrame([(1, 5.0, 5.0), (1, 0.0, 2.0), (1, 9.0, 10.0)], "user_id int, s_start double, s_end double")
    silences = spark.createDataFrame([(1, 5.0, 9.0), (1, 2.0, 5.0)], "user_id int, s_start double, s_end double")
    orders = [(a, b) for a in (speech, speech.orderBy("s_end")) for b in (silences, silences.orderBy("s_end"))]
    for a, b in orders + [(b, a) for a, b in orders]:
        monkeypatch.setattr(timelines, "hours", lambda *_, a=a, b=b: (a, b, None))
        rows = sorted(timelines.merged_segments(spark, None).collect())
        spans = {(r["seg_start"], r["seg_end"]) for r in rows}
        assert len(rows) == 5 and (5.0, 5.0) in spans
        place = {(r["seg_start"], r["seg_end"]): r["segment"] for r in rows}
        assert place[5.0, 5.0] == 2 and place[5.0, 9.0] == 3


def test_pairs_that_are_not_taken_are_not_shuffled(spark):
    d = long_run(spark).select("series", "frame_idx", "gain")
    other, taken = d.withColumnRenamed("gain", "later"), (C("frame_idx") + C("lag")) % 7 == 0
    few = joins.lagged_pairs(d, other, ["series"], range(-2, 3), taken=taken)
    every = joins.lagged_pairs(d, other, ["series"], range(-2, 3)).where(taken)
    assert sorted(few.collect()) == sorted(every.collect())
    lines = plan(few).splitlines()
    assert min(k for k, line in enumerate(lines) if "% 7" in line) > min(k for k, line in enumerate(lines) if "Join" in line)


def test_alignment_of_long_series_shuffles_few_pairs(spark):
    from cadenza.operators import envelopes

    d = long_run(spark, 30).select("series", "frame_idx", C("gain").alias("frame_db"), F.lit(True).alias("support"))
    lines = plan(envelopes.alignment(d, d, ["series"], 20.0)).splitlines()
    stride = [k for k, line in enumerate(lines) if "Filter" in line and "20000" in line]
    assert stride and all(any("Generate" in line for line in lines[k : k + 3]) for k in stride)


def test_rows_of_short_series_are_handed_back_together():
    import pandas as pd

    from cadenza.operators import sequential

    short = [pd.DataFrame({"k": [n], "x": [0.5]}) for n in range(100)]
    out = list(sequential.gathered(iter(short), 40))
    assert [len(d) for d in out] == [40, 40, 20] and pd.concat(out)["k"].tolist() == list(range(100))
    assert list(sequential.gathered(iter([]), 40)) == []


def test_review_of_named_fields_of_a_file(spark):
    """The other rules of a file are not worked out when nothing reads them."""
    d = spark.createDataFrame([('{"verdict": "risky", "confidence": 0.5, "perFileProfiles": [{"adaptiveDirectives": {"warmthDb": "1.5"}}]}',)], "answer string").withColumn("v", reviews.parsed(C("answer")))
    few = d.select(reviews.review(C("v"), "perFileProfiles", of_file=("adaptiveDirectives",))["perFileProfiles"][0].alias("f")).select("f.*")
    whole = d.select(reviews.review(C("v"))["perFileProfiles"][0].alias("f")).select("f.*")
    assert few.columns == ["fileName", "confidence", "adaptiveDirectives"] and few.collect() == whole.select(*few.columns).collect()


def test_sums_lose_nothing_to_rounding(spark):
    import math

    cases = [[0.1, 0.7, 1e16, 0.3, -1e16, 0.2], [0.1] * 10, [1e-9, 3.3, 1e9], [math.inf, 1.0], [7.5]]
    d = spark.createDataFrame([(k, v) for k, values in enumerate(cases) for v in values], "k int, x double")
    got = {r["k"]: r["s"] for r in d.groupBy("k").agg(sc.ordered_sum(C("x")).alias("s")).collect()}
    assert got == {k: math.fsum(values) for k, values in enumerate(cases)}


def test_verdict_at_a_gap_of_exactly_its_limit(spark, tmp_path):
    """An order of sf0.1 whose penalties, summed plainly from the smallest up, miss the limit by their last bit."""
    from cadenza.plans import relations

    rows = [(2, 18112, 48, 4, 15.0, 0.09, 0.04), (2, 13956, 423, 2, 42.0, 0.02, 0.06), (2, 1007, 734, 5, 14.0, 0.08, 0.01)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in relations.rule_assessment(spark, str(tmp_path)).collect()] == [(2, 0.733333, "challenger")]
