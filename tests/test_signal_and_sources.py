"""Signals against known levels, readers on awkward files, streams against batches."""

from __future__ import annotations

import json
import math
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import islands, signal
from tidemark.sources import carriers, documents
from tidemark.streaming import telemetry

DATA = "/root/testdata/sf0.001"
RATE = 48_000


def tone(spark, db, seconds, hz=1000.0, silence=0.0):
    t = np.arange(int(RATE * seconds)) / RATE
    x = np.concatenate((10 ** (db / 20) * np.sin(2 * np.pi * hz * t), np.zeros(int(RATE * silence))))
    size = RATE // 10
    return spark.createDataFrame([(1, k, x[k * size : (k + 1) * size].tolist()) for k in range(len(x) // size)], "key long, n long, samples array<double>")


@pytest.mark.parametrize(("db", "silence"), [(-23.0, 0.0), (-23.0, 4.0)])
def test_loudness_of_a_tone(spark, db, silence):
    got = signal.loudness(signal.weighted_energy(tone(spark, db, 3.0, silence=silence), RATE)).first()
    assert abs(got["lufs"] - (db - 3.0)) < 0.35  # one channel; the windows at the edge of the silence pass the gate


def test_silence_has_no_loudness(spark):
    assert signal.loudness(signal.weighted_energy(tone(spark, -200.0, 0.0, silence=1.0), RATE)).first()["lufs"] == -math.inf


def test_levels_and_peaks(spark):
    x = tone(spark, -6.0, 0.5, hz=RATE / 4)
    assert abs(signal.levels(x).agg(F.max("rms_db")).first()[0] - (-9.01)) < 0.05
    assert signal.true_peaks(x).agg(F.max("peak")).first()[0] >= signal.levels(x).agg(F.max("peak")).first()[0] - 1e-3
    cut = signal.limited(tone(spark, 0.0, 0.3), 0.5, RATE)
    assert signal.levels(cut).agg(F.max("peak")).first()[0] <= 0.5 + 1e-6


def test_spectra(spark):
    x = tone(spark, -6.0, 0.2, hz=440.0)
    row = signal.band_energies(x, RATE, 1000.0).first()
    assert row["low"] > 1000 * row["high"]
    assert len(signal.cepstra(x, RATE).first()["mfcc"]) == 20


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "x", "version": "2", "data": {"n": 1}}))
    (tmp_path / "b.json").write_text(json.dumps({"n": 2}))
    (tmp_path / "c.json").write_text("not json")
    got = {r["file"]: (r["id"], r["n"]) for r in documents.json_documents(spark, str(tmp_path), "n int").collect()}
    assert got == {"a.json": ("x", 1), "b.json": (None, 2), "c.json": (None, None)}
    assert [r["file"] for r in documents.listing(spark, str(tmp_path)).collect()] == ["a.json", "b.json", "c.json"]


def test_frequencies_and_tokens(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"le": 3, "the": 1}))
    assert {r["word"]: r["share"] for r in documents.frequencies(spark, str(tmp_path)).collect()} == {"le": 0.75, "the": 0.25}
    rows = [(0, " win", 0.5, -0.2), (1, "dow", 0.6, -0.7), (2, " is", 1.0, 0.0), (3, " op", 1.4, -0.1), (4, "en", 1.5, -0.3), (5, ".", 1.6, -0.05)]
    df = spark.createDataFrame([(9, *r) for r in rows], "key long, i long, token string, t double, logprob double")
    got = documents.words_of_tokens(df, after=0.7).orderBy("n").collect()
    assert [(r["w"], round(r["a"], 2), round(r["b"], 2)) for r in got] == [("is", 1.0, 1.16), ("open.", 1.4, 1.76)]
    assert [round(r["p"], 9) for r in got] == [1.0, round(math.exp(-0.3), 9)]


def test_probes(spark):
    text = "Duration: 01:02:03.50, start\nStream #0: Video: h264 (High) (avc1), yuv420p, 1440x1080 [SAR 4:3 DAR 16:9], 30 fps\ndisplaymatrix: rotation of -90.00 degrees"
    df = spark.createDataFrame([(text,), ("",)], "p string")
    got = df.select(documents.duration(F.col("p")).alias("d"), documents.coded_size(F.col("p")).alias("c"), documents.display_size(F.col("p")).alias("s")).collect()
    assert got[0]["d"] == 3723.5 and got[0]["c"][:] == (1440, 1080) and got[0]["s"][:] == (1080, 1920)
    assert got[1]["d"] == 0.0 and got[1]["c"][:] == (None, None)
    one = spark.range(1)
    assert one.select(documents.flat_fields(F.lit("h264 (High (x), y), yuv, 30 fps"))).first()[0] == ["h264", "yuv", "30 fps"]
    assert one.select(documents.voice_activity(F.lit("start = 150.0, end = 275.0\nstart = 300, end = 400"))).first()[0] == [(1.5, 2.75), (3.0, 4.0)]
    assert one.select(documents.scene_times(F.lit("pts_time:2.5 x pts_time:1 pts_time:2.5"))).first()[0] == [1.0, 2.5]
    assert [tuple(x) for x in one.select(documents.query_fields(F.lit("http://h/p?a=1%202&b=&c=3"))).first()[0]] == [("a", "1 2"), ("b", ""), ("c", "3")]


def test_wave_files(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setparams((1, 2, 16000, 0, "NONE", ""))
        w.writeframes((np.ones(16000 * 2) * 16384).astype("<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"not a wave")
    got = documents.signals(spark, str(tmp_path), 0.5).orderBy("n").collect()
    assert [(r["file"], r["n"], len(r["samples"])) for r in got] == [("a.wav", k, 8000) for k in range(4)] and got[0]["samples"][0] == 0.5


def test_publish_parts(spark):
    got = documents.publish_parts(spark.createDataFrame([("a", 25), ("b", 0), ("c", 10)], "file string, bytes long"), 10).collect()
    assert sorted((r["file"], r["part"], r["bytes"]) for r in got) == [("a", 0, 10), ("a", 1, 10), ("a", 2, 5), ("b", 0, 0), ("c", 0, 10)]


def run_stream(spark, tmp_path, df, build, name, mode):
    source = str(tmp_path / "in")
    df.repartitionByRange(3, "ts").write.parquet(source)
    for k, part in enumerate(sorted((tmp_path / "in").glob("part-*"))):  # the stream reads files by their age
        os.utime(part, (1_700_000_000 + 10 * k,) * 2)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    got = run_stream(spark, tmp_path, events, lambda s: telemetry.windowed_counts(telemetry.as_events(s), "6 hours", late="60 days"), "counts", "update")
    last = got.groupBy("start", "kind").agg(F.max("n").alias("n"))
    want = telemetry.as_events(events).groupBy(F.window("ts", "6 hours"), "kind").agg(F.count("*").alias("n"))
    assert sorted((str(r["start"]), r["kind"], r["n"]) for r in last.collect()) == sorted((str(r["window"]["start"]), r["kind"], r["n"]) for r in want.collect())


def test_sessions_are_the_closed_ones_of_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").orderBy("ts")
    got = run_stream(spark, tmp_path, events, lambda s: telemetry.pause_sessions(telemetry.as_events(s), 6 * 3600, "40 days"), "sessions", "append")
    batch = islands.pause_chunks(carriers.points(spark, DATA), 6 * carriers.HOUR)
    want = {(r["key"], r["s"] // 10**6, r["e"] // 10**6, r["n"]) for r in batch.collect()}
    found = {(r["key"], int(r["s"].timestamp()), int(r["e"].timestamp()), r["n"]) for r in got.collect()}
    assert found <= want and len(want) - len(found) <= batch.select("key").distinct().count() and found


def test_progress(spark, tmp_path):
    rows = [(k, 1, f"2024-01-01 00:00:{k:02d}", line) for k, line in enumerate(["@progression 1 4 a", "noise", "@progression 4 4 a", "@progression 1 2 b", "@progression 0 2 b", "@progression 1e+06 x c"])]
    df = spark.createDataFrame(rows, "event_id long, key long, at string, line string").selectExpr("event_id", "key", "cast(at as timestamp) as ts", "line")
    got = run_stream(spark, tmp_path, df, lambda s: telemetry.job_status(telemetry.progress_lines(s), 2), "status", "update").collect()
    assert max(r["overall"] for r in got) == 0.75 and sorted(r["overall"] for r in got) == [r["overall"] for r in got]
