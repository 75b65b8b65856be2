from __future__ import annotations

import json
import struct
import zipfile

import numpy as np
import pytest

from cadenza.sources import manifests, wav


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(spark, tmp_path, bits):
    rng = np.random.default_rng(bits)
    x = np.clip(rng.uniform(-1, 1, 1000), -1, 1).astype(np.float32)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.encode(x, 8000, 1, bits))
    (tmp_path / "in" / "b.wav").write_bytes(wav.encode(np.repeat(x, 2), 8000, 2, bits))
    spark.dataSource.register(wav.WavSource)
    rows = spark.read.format("wav").option("chunk", 300).option("task", 600).load(str(tmp_path / "in")).orderBy("path", "first_sample").collect()
    assert [r["first_sample"] for r in rows] == [0, 300, 600, 900] * 2 and rows[0]["channels"] == 1 and rows[4]["channels"] == 2
    for part in (rows[:4], rows[4:]):
        assert np.allclose(np.concatenate([r["samples"] for r in part]), x, atol=2 / (1 << min(bits, 24) - 1))
    again = wav.read_wav(spark, f"file://{tmp_path}/in", 300).orderBy("path", "first_sample").collect()
    assert [r["samples"] for r in again] == [r["samples"] for r in rows]


def test_wav_headers(spark, tmp_path):
    good = wav.encode(np.zeros(10), 44100, 1, 16)
    extensible = struct.pack("<4sI4s4sIHHIIHHHHIH14s", b"RIFF", 0, b"WAVE", b"fmt ", 40, 0xFFFE, 1, 8000, 16000, 2, 16, 22, 16, 0, 1, b"") + struct.pack("<4sI", b"data", 8) + b"\0" * 6
    files = {"good": good, "ext": extensible, "short": b"RIFF", "text": b"hello world, no sound", "float16": good.replace(struct.pack("<HH", 1, 1), struct.pack("<HH", 3, 1), 1)}
    d = spark.createDataFrame(list(files.items()), "n string, c binary").select("n", wav.header("c").alias("h")).select("n", "h.*")
    got = {r["n"]: r for r in d.collect()}
    assert got["good"]["frames"] == 10 and got["good"]["error"] is None and got["ext"]["frames"] == 3
    assert all(got[n]["error"] for n in ("short", "text", "float16"))


def test_wav_writer(spark, tmp_path):
    spark.dataSource.register(wav.WavSource)
    d = spark.createDataFrame([("x.wav", 8000, [0.0, 0.5, -0.5])], "name string, sample_rate int, samples array<float>")
    d.write.format("wav").option("bits", 16).mode("append").save(str(tmp_path / "out"))
    raw = (tmp_path / "out" / "x.wav").read_bytes()
    assert np.allclose(wav.decode(raw[44:], wav.parse_header(raw, len(raw)))[:, 0], [0, 0.5, -0.5], atol=1e-4)


def bundle(version=1):
    return {"schemaVersion": version, "bundleId": f"b{version}", "generatedAt": "t", "candidates": [{"role": "winner", "label": "a", "qc": {"risk": 0.2}, "ranking_score": 1.5}, {"role": "challenger"}]}


def test_bundles_and_manifests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("manifest.json", json.dumps(bundle()))
        z.writestr("audio/a.wav", b"1234")
    (tmp_path / "other").mkdir()
    for name, text in (("y", json.dumps(bundle(2))), ("z", "{nope")):
        with zipfile.ZipFile(tmp_path / "other" / f"{name}.zip", "w") as z:
            z.writestr("manifest.json", text)
        with pytest.raises(Exception, match=f"unsupported review bundle schema in .*{name}.zip"):
            manifests.read_bundles(spark, str(tmp_path / "other" / f"{name}.zip")).collect()
    got = manifests.read_bundles(spark, str(tmp_path / "x.zip")).orderBy("role").collect()
    assert [(r["bundleId"], r["role"]) for r in got] == [("b1", "challenger"), ("b1", "winner")] and got[1]["qc"] == {"risk": 0.2}
    assert {r["member"]: r["bytes"] for r in manifests.unzip(spark, str(tmp_path)).where("member like 'audio%'").collect()} == {"audio/a.wav": 4}
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "deep" / "er" / "manifest.json").write_text(json.dumps(bundle(), indent=1))
    assert manifests.read_manifests(spark, str(tmp_path)).count() == 2


def test_decisions_and_pairs(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"schemaVersion": 1, "bundleId": "b", "finalVerdict": "pass", "issueTags": ["x"]}\n\n  \n')
    d = manifests.read_decisions(spark, str(tmp_path / "d.jsonl"))
    assert [(r["bundleId"], r["issueTags"]) for r in d.collect()] == [("b", ["x"])]
    manifests.write_decisions(d, str(tmp_path / "out"))
    assert manifests.read_decisions(spark, str(tmp_path / "out")).collect() == d.collect()
    (tmp_path / "bad.jsonl").write_text("{nope\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        manifests.read_decisions(spark, str(tmp_path / "bad.jsonl")).collect()
    for k, doc in enumerate(([{"id": "1", "source": "s", "output": "o"}], {"pairs": [{"id": "1", "source": "s", "result": "o"}]}, {"selected": [{"id": "1", "source": "s", "result": "o"}]})):
        (tmp_path / f"p{k}.json").write_text(json.dumps(doc))
        assert [tuple(r) for r in manifests.pair_specs(spark, str(tmp_path / f"p{k}.json")).collect()] == [("1", "s", "o")]
