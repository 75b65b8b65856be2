"""Registered queries on WAV bytes: every vector is written as a file of 8 kHz, most of them with a fault by its id."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cadenza.sources import wav, wav_checks
from cadenza.plans.queries import query, r, table

C, RATE, KINDS = F.col, 8000, 16


def _file(kind: int, samples: np.ndarray) -> bytes:
    """A file with fault number `kind`; 0, 7 and 13 have none."""
    x = np.array(samples, np.float32)
    if kind == 11:
        x[0] = np.nan
    if kind == 12:
        x[1] = 2.0
    raw = bytearray(wav.encode(x, RATE, 1, 16 if kind == 13 else 32))
    put = lambda at, form, value: raw.__setitem__(slice(at, at + struct.calcsize(form)), struct.pack(form, value))
    if kind == 1:
        raw[:4] = b"RIFX"
    elif kind == 3:
        put(40, "<I", len(raw) + 64)
    elif kind == 4:
        put(34, "<H", 24)
    elif kind == 5:
        put(22, "<H", 3)
    elif kind == 6:
        put(24, "<I", 11025)
    elif kind == 7:
        raw[36:36] = b"LIST" + struct.pack("<I", 5) + b"odd.." + b"\0"
    elif kind == 8:
        raw[36:36] = raw[12:36]
    elif kind == 9:
        raw += b"data" + struct.pack("<I", 4) + b"\0" * 4
    elif kind == 10:
        del raw[-2:]
        put(40, "<I", len(raw) - 44)
    elif kind == 14:
        raw += b"tail"
    elif kind == 15:
        del raw[36:]
        raw += b"junk" + struct.pack("<I", 8) + b"\0" * 8
    put(4, "<I", len(raw) - 8 + (kind == 2))
    return bytes(raw)


def files(spark, sf_dir, kind):
    @F.pandas_udf("binary")
    def made(kind: pd.Series, samples: pd.Series) -> pd.Series:
        return pd.Series([_file(int(k), x) for k, x in zip(kind, samples)])

    v = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null and size(embedding) = 64 and forall(embedding, x -> abs(x) <= 1)")
    return v.select("vec_id", "embedding", made(kind, C("embedding")).alias("content"))


_VECTORS = "embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT coalesce(abs(x) <= 1, false))) = 0"
_FAULTS = {
    1: "not a RIFF/WAVE file", 2: "RIFF size does not match uploaded bytes", 3: "truncated chunk", 4: "IEEE float WAV must use 32-bit samples", 5: "channel count outside allowlist", 6: "sample rate outside allowlist",
    8: "invalid format chunk", 9: "multiple data chunks", 10: "invalid audio data length", 11: "non-finite-float-samples", 12: "out-of-range-float-samples", 14: "truncated chunk header", 15: "missing required WAV chunks",
}


@query(f"""WITH v AS (SELECT vec_id, vec_id % {KINDS} AS k FROM {_VECTORS}), e AS (SELECT *, CASE k {' '.join(f"WHEN {k} THEN '{t}'" for k, t in _FAULTS.items())} END AS error FROM v)
 SELECT vec_id, CASE WHEN error IS NULL THEN CASE WHEN k = 13 THEN 1 ELSE 3 END END::INT AS format, CASE WHEN error IS NULL THEN {RATE} END::INT AS sample_rate, CASE WHEN error IS NULL THEN 1 END::INT AS channels, CASE WHEN error IS NULL THEN CASE WHEN k = 13 THEN 2 ELSE 4 END END::INT AS width_bytes,
 CASE WHEN error IS NULL THEN 64 END::BIGINT AS frames, CASE WHEN error IS NULL THEN 0.008 END::DOUBLE AS duration_sec, CASE WHEN error IS NULL THEN CASE WHEN k = 7 THEN 58 ELSE 44 END END::BIGINT AS data_offset, CASE WHEN error IS NULL THEN CASE WHEN k = 13 THEN 128 ELSE 256 END END::BIGINT AS data_bytes, error FROM e""")  # fmt: skip
def wav_refusals(spark, sf_dir):
    """What the strict check says of each file."""
    d = files(spark, sf_dir, C("vec_id") % KINDS).select("vec_id", wav_checks.inspect(C("content")).alias("i")).select("vec_id", "i.*")
    return d.withColumn("duration_sec", r("duration_sec"))


def _le(x: str) -> str:
    return f"substr(printf('%08X', {x}), 7, 2) || substr(printf('%08X', {x}), 5, 2) || substr(printf('%08X', {x}), 3, 2) || substr(printf('%08X', {x}), 1, 2)"


@query(f"""WITH v AS (SELECT vec_id, embedding, CASE WHEN vec_id % 3 = 0 THEN 7 WHEN vec_id % 11 = 5 THEN 13 WHEN vec_id % 13 = 6 THEN 3 ELSE 0 END AS k, (vec_id % 70) / {RATE}.0 AS s, (vec_id % 20 - 1) / {RATE}.0 AS d FROM {_VECTORS}),
 w AS (SELECT *, least(64, floor(s * {RATE} + 0.5))::BIGINT AS a, CASE WHEN k = 13 THEN 'Bounded QC expects mono pcm_f32le audio.' WHEN k = 3 THEN 'Corrupt WAV: data chunk exceeds the file.' WHEN d <= 0 THEN 'Bounded QC window duration must be a finite positive value.'
 WHEN floor(s * {RATE} + 0.5) >= 64 THEN 'Bounded QC window starts after the WAV audio data.' END AS error FROM v), n AS (SELECT *, least(greatest(1, floor(d * {RATE} + 0.5)), 64 - a)::INT AS n FROM w)
 SELECT vec_id, CASE WHEN error IS NULL THEN a END AS start_sample, CASE WHEN error IS NULL THEN n END::BIGINT AS sample_count, CASE WHEN error IS NULL THEN round(n / {RATE}.0, 6) END::DOUBLE AS duration_sec,
 CASE WHEN error IS NULL THEN '52494646' || {_le("(36 + 4 * n)")} || '57415645666D74201000000003000100401F0000007D00000400200064617461' || {_le("(4 * n)")} END AS header, CASE WHEN error IS NULL THEN list_transform(embedding[a + 1:a + n], lambda x: round(x::DOUBLE, 6)) END AS samples, error FROM n""")  # fmt: skip
def wav_windows(spark, sf_dir):
    """A stretch of each file as a file of its own: its header, and the samples read back."""
    k = C("vec_id")
    kind = F.when(k % 3 == 0, 7).when(k % 11 == 5, 13).when(k % 13 == 6, 3).otherwise(0)
    d = files(spark, sf_dir, kind).withColumn("info", wav_checks.mono_float(C("content")))
    d = d.select("vec_id", wav_checks.window(C("content"), C("info"), k % 70 / RATE, (k % 20 - 1) / RATE).alias("w"))

    @F.pandas_udf("array<double>")
    def back(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: None if x is None else [round(float(v), 6) for v in wav.decode(bytes(x[44:]), wav.parse_header(bytes(x), len(x)))[:, 0]])

    header = F.hex(F.substring("w.bytes", 1, 44))
    return d.select("vec_id", "w.start_sample", "w.sample_count", r("w.duration_sec").alias("duration_sec"), header.alias("header"), back("w.bytes").alias("samples"), "w.error")
