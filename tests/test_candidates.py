"""Names, logs, loose values and gates against written cases, edge cases among them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cadenza.functions import texts as tx
from cadenza.operators import candidates as cd
from cadenza.operators import segments

C = F.col


def column(spark, values, expr, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in d.orderBy("i").select(expr(C("x"))).collect()]


def test_keys(spark):
    names = ["a/Result - Ångström Línea MixReady v2.wav", "source_two.wav", "ﬁne.wav", ".hidden", "", None, "Original.wav"]
    assert column(spark, names, tx.corpus_key) == ["angstromlinea", "two", "fine", "hidden", "", None, "original"]
    names = ["Before  My Voice.wav", "after_my voice_blend_mixready.wav", "My-Voice_a85.wav", "__x__.wav", "", None]
    assert column(spark, names, tx.comparison_key) == ["my_voice", "my_voice", "my-voice", "x", "", None]


def test_roles(spark):
    names = ["x_after.wav", "after_before.wav", "raw take.wav", "x_r128.wav", "x_mixready.wav", "rawhide.wav", "x_r128.wav\n", None]
    assert column(spark, names, tx.guess_role) == ["unknown", "after", "before", "after", "after", "unknown", "unknown", None]
    paths = ["a/Result/x.wav", "the result\\x\\y.wav", "result.wav", "RESULT - x.wav", "result/", "x/y.wav"]
    assert column(spark, paths, tx.is_result_path) == [True, True, False, True, True, False]


def test_safe_names(spark):
    k = F.lit(0)
    names = ["a/b\\con.wav", "x?.y.wav", "...", "", "tail .. .wav", None]
    assert column(spark, names, lambda x: tx.safe_base(x, k)) == ["con_file", "x_.y", "input_1", "input_1", "tail", None]
    assert column(spark, ["a/ b. ", "..", "q\x00.wav", None], lambda x: tx.safe_download_name(x, F.lit("d"))) == ["b", "d", "q_.wav", None]
    names = ["x.WAV", "dir/x.wav", "a..b.wav", " x.wav", "aux.wav", ".wav", "longname", "abc", "a", None]
    want = ["x.wav", None, None, None, "aux_file.wav", "input_1.wav", "long.wav", "ab.wav", "input_1.wav", None]
    assert column(spark, names, lambda x: tx.safe_upload_name(x, k)) == want
    assert column(spark, ["a b--c.d.wav", "é", ""], tx.short_base) == ["a_b--c_d", "_", ""]


def test_logs(spark):
    assert column(spark, ["RMS level dB: -20.5\nrms LEVEL db: inf", "RMS level dB: 3", "none", "", None], tx.last_rms_db) == [-120.0, 3.0, None, None, None]
    assert column(spark, ["Duration: 01:02:03.5, Duration: 00:00:01", "Duration: 1:2:3", None], tx.duration_seconds) == [3723.5, None, None]
    assert column(spark, ['{"a": "1"} {"b": 2}', "{bad}", "none", "", None], tx.last_object) == [{"b": "2"}, None, None, None, None]
    logs = ["one\r\n Error a\nb\nfailed c\ninvalid d\naborted e", "a\n\n b \nc\nd", "", None]
    assert column(spark, logs, tx.failure_summary) == ["failed c | invalid d | aborted e", "b | c | d", "", None]
    assert column(spark, ["Watchdog TIMEOUT", "fine", "", None], tx.is_recoverable) == [True, False, False, False]


def test_loose_values(spark):
    texts = [" 1.2345 ", "-1.2345", "", "1d", "0x1F", "0b101", "0o17", "1e400", "NaN", "five", None]
    assert column(spark, texts, tx.loose_number) == [1.235, -1.234, 0.0, None, 31.0, 5.0, 15.0, None, None, None, None]
    assert column(spark, ["a\x00 \t b ", "\n", "", None, "long text"], lambda x: tx.clean_text(x, "none", 6)) == ["a b", "none", "none", "none", "long t"]
    specs = [" a | b |id:1", "a|b", "a||c", "a|b|-x", "a|b|" + "x" * 129, None]
    assert [r and tuple(r) for r in column(spark, specs, tx.pair_spec)] == [("a", "b", "id:1"), None, None, None, None, None]
    assert column(spark, [3.4, 4.0, 9.0, 100.0, -5.0, 3.5, None], lambda x: tx.odd_integer(x, 2, 10), "double") == [3, 5, 9, 9, 3, 5, None]


@pytest.mark.parametrize(("verdicts", "want"), [(["ready", "risky", "adjust"], "risky"), (["adjust", None], "adjust"), ([None], "ready"), ([], "ready"), (["odd"], "ready")])
def test_worst_verdict(spark, verdicts, want):
    assert spark.createDataFrame([(v,) for v in verdicts], "v string").agg(tx.worst_verdict(C("v"))).first()[0] == want


def test_gates(spark):
    rows = [(["peak-violation", "x", "peak-violation"], []), (["source-regression", "ending-damage", "end-edge-dip"], ["audibility-dropout-guard"]), ([], [])]
    d = spark.createDataFrame(rows, "g array<string>, d array<string>")
    got = d.select(cd.technical_reasons(C("g")), cd.advisory_reasons(C("g")), cd.wants_linear_recovery(C("g")), cd.wants_source_safe(C("g"), C("d")), cd.delivers_enhanced(C("g"))).collect()
    assert [tuple(r) for r in got] == [
        (["peak-violation", "peak-violation"], ["x"], False, True, False),
        ([], ["source-regression", "ending-damage", "end-edge-dip"], True, True, True),
        ([], [], False, False, True),
    ]


def test_next_fallback(spark):
    plain, labels = ["a", "b", "c"], ["a", cd.AUDIBILITY_SAFE, "b", cd.TAIL_SAFE, "c"]
    for strategies, at, want in ((plain, 0, 1), (plain, 2, None), (plain, -1, None), (labels, 0, 3), (labels, 3, 4), ([cd.TAIL_SAFE, "a", cd.AUDIBILITY_SAFE, "b"], 0, 2), ([], 0, None)):
        d = spark.createDataFrame([(strategies, at)], "s array<string>, k int")
        assert d.select(cd.next_fallback(C("s"), C("k"))).first()[0] == want


def test_measured_and_risk(spark):
    d = spark.createDataFrame([(None, 0.5), (0, 0.5), (1, 0.5), (0, None), (0, float("nan"))], "w int, e double")
    assert [r[0] for r in d.select(cd.measurement_status([C("w")], [C("e")])).collect()] == ["measured", "measured", "partial", "partial", "partial"]
    d = spark.createDataFrame([(None, 5000.0), (4800.0, 9999.0), (float("nan"), 4801.0), (None, None)], "s double, e double")
    assert [r[0] for r in d.select(cd.long_form(C("s"), C("e"))).collect()] == [True, False, True, False]


def test_choose_unmeasured(spark):
    def row(k, index, gates, degraded, path, healthy, variant, rank, audio=True):
        return (k, index, audio, gates, degraded, path, healthy, variant, rank, 0.0, 0.0, 0.0, 0.0, 0.0)

    qc = ["qc-unavailable"]
    rows = [
        row(1, 0, qc, ["audibility-dropout-guard"], "fixed-segmented", True, "cinematic-stable", 0.1),
        row(1, 1, qc, qc, "single-pass", False, "pause-safe", 0.9),
        row(1, 2, qc, [], "single-pass", False, "pause-safe", 0.2),
        row(1, 3, qc, [], "fixed-segmented", True, "cinematic-stable", 0.0, audio=False),
        row(2, 0, qc + ["planner-required"], [], "single-pass", False, "pause-safe", 0.2),
        row(3, 0, qc, [], "fixed-segmented", True, "other", None),
    ]
    kind = "k int, index int, has_audio boolean, gates array<string>, degraded array<string>, path string, healthy boolean, variant string, rank double, stability double, pause double, compression double, echo double, total double"
    got = {r["k"]: (r["index"], r["reason"]) for r in cd.choose_unmeasured(spark.createDataFrame(rows, kind), ["k"]).collect()}
    assert got == {1: (2, "QC-unavailable fallback from rendered audio"), 3: (0, "QC-unavailable fallback from healthy rendered segmented audio")}


def test_speech_map(spark):
    frames = [("a", i, i % 100 < 2) for i in range(500)] + [("b", 0, False), ("c", 0, True)]
    d = spark.createDataFrame(frames, "s string, frame_idx long, on boolean")
    got = {r["s"]: r for r in segments.speech_map(d, ["s"], "on", 1.0).collect()}
    assert (got["a"]["duty_pct"], got["a"]["n_speech"], got["a"]["median_run_ms"], got["a"]["long_silences"], got["a"]["long_sparse"]) == (2.0, 5, 2000.0, 5, True)
    assert (got["b"]["duty_pct"], got["b"]["n_speech"], got["b"]["median_run_ms"], got["b"]["long_sparse"]) == (0.0, 0, 0.0, False)
    assert got["c"]["duty_pct"] == 100.0
