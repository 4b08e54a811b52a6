"""Probe texts of several shapes, and texts without what is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.sources import probes

FULL = """Input #0, mov, from 'x.mov':
  Duration: 00:00:10.25, start: 0.000000, bitrate: 900 kb/s
  Stream #0:0[0x1](und): Video: hevc (Main (10 (b)), c) (hvc1 / 0x31), yuv420p10le(tv, bt2020(x)), 3840x2160, 8000 kb/s, 29.97 fps, 29.97 tbr, 600 tbn (default)
      displaymatrix: rotation of -90.00 degrees
  Stream #0:1[0x2](und): Audio: aac (LC) (mp4a / 0x6134706D), 44100 Hz, mono, fltp, 96 kb/s (default)
  Stream #0:2[0x3](und): Audio: none (apac / 0x63617061), 48000 Hz
  Stream #0:3[0x4](und): Audio: pcm_s16le, 48000 Hz, 2 channels
"""
FAST = "  Stream #0:0: Video: mjpeg, yuvj444p, 60x40, 1k tbr, 12.5 fps\n"


def told(spark, *columns):
    df = spark.createDataFrame([(0, FULL), (1, FAST), (2, "nothing of this kind"), (3, None)], "id long, probe string")
    return {r["id"]: r for r in df.select("id", *columns).collect()}


def test_tracks_and_media(spark):
    p = F.col("probe")
    got = told(spark, probes.audio_tracks(p).alias("t"), probes.media(p).alias("m"), probes.example(p).alias("e"))
    assert [x["track"] for x in got[0]["t"]] == [0, 2] and got[0]["t"][1]["description"].startswith("pcm") and not got[2]["t"] and not got[3]["t"]
    assert tuple(got[0]["m"]) == (10.25, 3840, 2160, 29.97, "hevc", 8000.0, True, "aac", 96.0)
    assert tuple(got[1]["m"]) == (0.0, 60, 40, 12.5, "mjpeg", 0.0, False, "", 0.0)
    assert tuple(got[3]["m"]) == (0.0, 0, 0, 0.0, "", 0.0, False, "", 0.0)
    assert tuple(got[0]["e"]) == (10.25, 2160, 3840) and tuple(got[2]["e"]) == (0.0, 0, 0)


def test_settings(spark):
    got = told(spark, probes.settings(F.col("probe")).alias("s"))
    assert tuple(got[0]["s"]) == (10.25, "hevc", "yuv420p10le", 3840, 2160, 29.97, 270, [0, 2], "aac", "44100 Hz", "mono")
    assert got[1]["s"]["audio_codec"] is None and got[1]["s"]["fps"] == 12.5 and got[2]["s"] is None and got[3]["s"] is None


def test_rates(spark):
    df = spark.createDataFrame([(0, FULL), (1, FAST), (2, "x"), (3, None), (4, FAST.replace("12.5", "0.5")), (5, FAST.replace("1k tbr", "14.985 tbr"))], "id long, probe string")
    got = {r["id"]: tuple(r["rate"]) for r in probes.with_rate(df, "probe").collect()}
    assert got == {0: (30000, 1001), 1: (25, 2), 2: (30, 1), 3: (30, 1), 4: (30, 1), 5: got[5]}
    assert abs(got[5][0] / got[5][1] - 14.985) < 1e-3 and got[5][1] <= 1000


def test_joinable(spark):
    df = spark.createDataFrame([(1, FULL), (1, FULL.replace("10.25", "11.00")), (2, FULL), (2, FULL.replace("44100", "48000")), (3, FAST)], "key long, probe string")
    got = {r["key"]: (r["files"], r["same"]) for r in probes.same_settings(df.withColumn("settings", probes.settings(F.col("probe"))), ["key"]).collect()}
    assert got == {1: (2, True), 2: (2, False), 3: (1, False)}
