"""Streams give what their batch twins give."""

from __future__ import annotations

import datetime as dt

from cadenza.streaming import stateful

T0 = dt.datetime(2024, 1, 1)


def through(spark, tmp_path, rows, schema, build, mode="append"):
    """Rows in two files, read one file at a time, through a streaming query; the final rows."""
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = build(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table("out").collect()]


def test_fixed_windows(spark, tmp_path):
    rows = [("a" if i % 3 else "b", T0 + dt.timedelta(seconds=20 * i)) for i in range(30)]
    got = through(spark, tmp_path, rows, "owner string, at timestamp", lambda s: stateful.fixed_windows(s, "owner", "at", "1 minute", 1), "complete")
    batch = [tuple(r) for r in stateful.fixed_windows(spark.createDataFrame(rows, "owner string, at timestamp"), "owner", "at", "1 minute", 1).collect()]
    assert sorted(got) == sorted(batch) and sum(r[2] for r in got) == 30


def test_first_requests(spark, tmp_path):
    rows = [(f"k{i % 4}", T0 + dt.timedelta(seconds=i)) for i in range(12)]
    got = through(spark, tmp_path, rows, "key string, at timestamp", lambda s: stateful.first_requests(s, ["key"], "at"))
    assert sorted(k for k, _ in got) == ["k0", "k1", "k2", "k3"]


def test_leases(spark, tmp_path):
    rows = [("j", T0 + dt.timedelta(seconds=s)) for s in (0, 10, 20, 100, 105, 300)]
    got = through(spark, tmp_path, rows, "job string, at timestamp", lambda s: stateful.leases(s, "job", "at", 30))
    states = [s for _, _, s in sorted(got)]
    assert len(states) == 6 and states.count("leased") >= 3


def test_gate(spark, tmp_path):
    rows = [("s", i, -20.0 if 10 <= i < 15 else -80.0) for i in range(60)]
    schema = "k string, frame_idx long, db double"
    got = {i: a for _, i, a in through(spark, tmp_path, rows, schema, lambda s: stateful.gate(s.repartition(1), "k", "frame_idx", "db", -75.0))}
    assert len(got) == 60 and all(got[i] for i in range(10, 15))
