"""Strict WAV checks and windows: one fault at a time, every byte cut off, and windows against slices."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import wav
from cadenza.sources.wav_checks import Limits, inspect, inspected, mono_float, mono_prefix, window

X = np.linspace(-0.9, 0.9, 500).astype(np.float32)


def extensible(guid="0300000000001000800000aa00389b71", valid=32, extra=22):
    form = struct.pack("<HHIIHHHHI", 0xFFFE, 1, 8000, 32000, 4, 32, extra, valid, 4) + bytes.fromhex(guid)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 2000) + X.tobytes()
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_good_files():
    for bits, width, code in ((32, 4, 3), (16, 2, 1), (24, 3, 1)):
        raw = wav.encode(X, 8000, 1, bits)
        assert inspected(raw) == (code, 8000, 1, width, 500, 500 / 8000, 44, 500 * width, None)
    assert inspected(extensible())[0] == 3 and mono_prefix(extensible(), len(extensible()))[:4] == (8000, 68, 2000, 500)


@pytest.mark.parametrize(
    "raw, error",
    [
        (None, "no file"), (b"", "not a RIFF/WAVE file"), (extensible(valid=24), "unsupported extensible valid-bit width"), (extensible(extra=23), "invalid extensible format size"),
        (extensible(guid="0200000000001000800000aa00389b71"), "unsupported extensible WAV subformat"), (wav.encode(X, 7000), "sample rate outside allowlist"), (wav.encode(X[:0], 8000), "invalid audio data length"),
        (wav.encode(np.append(X, [2, np.nan]), 8000), "out-of-range-float-samples"), (wav.encode(np.append(X, [np.nan, 2]), 8000), "non-finite-float-samples"), (wav.encode(np.append(X, -np.inf), 8000), "non-finite-float-samples"),
    ],
)
def test_refusals(raw, error):
    assert inspected(raw) == (None,) * 8 + (error,)


def test_limits():
    raw = wav.encode(X, 8000)
    for limits, error in ((Limits(most_bytes=100), "upload exceeds byte limit"), (Limits(most_seconds=0.01), "duration exceeds limit"), (Limits(most_frames=499), "decoded frame count exceeds limit"), (Limits(widths=frozenset({2})), "sample width outside allowlist")):
        assert inspected(raw, limits)[-1] == error


def test_every_cut_is_refused():
    """However a file is cut, and whatever size it then claims, no reader goes beyond its end."""
    raw = wav.encode(X[:6], 8000)
    for n in range(len(raw)):
        claimed = raw[:4] + struct.pack("<I", max(0, n - 8)) + raw[8:n] if n >= 8 else raw[:n]
        assert inspected(raw[:n])[-1] and inspected(claimed[:n])[-1], n
        assert mono_prefix(raw[:n], n)[-1], n


def test_a_long_chunk_before_the_samples():
    junk = b"junk" + struct.pack("<I", 5 << 20) + bytes(5 << 20)
    raw = bytearray(wav.encode(X, 8000))
    raw[12:12] = junk
    raw[4:8] = struct.pack("<I", len(raw) - 8)
    assert mono_prefix(bytes(raw[: 4 << 20]), len(raw))[-1] == "WAV metadata prefix exceeds the bounded inspection limit."
    assert inspected(bytes(raw))[-1] is None


def test_windows_are_slices(spark):
    odd = bytearray(wav.encode(X, 8000))
    odd[36:36] = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    odd[4:8] = struct.pack("<I", len(odd) - 8)
    rows = [(k, bytearray(raw), a, n) for k, (raw, a, n) in enumerate([(wav.encode(X, 8000), 0.0, 1.0), (bytes(odd), 0.01, 0.02), (bytes(odd), 0.0624, 5.0), (wav.encode(X, 8000), 0.0625, 1.0), (wav.encode(X, 8000, 1, 16), 0.0, 1.0), (wav.encode(X, 8000), float("nan"), 1.0), (wav.encode(X, 8000), 0.0, 0.0), (b"x", 0.0, 1.0)])]
    rows.append((8, None, 0.0, 1.0))
    d = spark.createDataFrame(rows, "k int, content binary, a double, n double").withColumn("info", mono_float(F.col("content")))
    got = {r["k"]: r["w"] for r in d.select("k", window(F.col("content"), F.col("info"), F.col("a"), F.col("n")).alias("w")).collect()}
    for k, (a, b) in enumerate([(0, 500), (80, 240), (499, 500)]):
        w = got[k]
        assert bytes(w["bytes"]) == wav.encode(X[a:b], 8000) and (w["start_sample"], w["sample_count"], w["error"]) == (a, b - a, None)
        assert inspected(bytes(w["bytes"]))[-1] is None
    assert [got[k]["error"] for k in range(3, 9)] == [
        "Bounded QC window starts after the WAV audio data.", "Bounded QC expects mono pcm_f32le audio.", "Bounded QC window start must be a finite non-negative value.",
        "Bounded QC window duration must be a finite positive value.", "WAV is too small for bounded QC.", "WAV is too small for bounded QC.",
    ]
    (info,) = [r["i"] for r in d.where("k = 1").select(inspect(F.col("content")).alias("i")).collect()]
    assert info["data_offset"] == 44 + 12 and info["frames"] == 500
