"""Tracks, clips and merged transcripts on small cases."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators import align, tracks


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_present_and_rebased(spark):
    s = spark.createDataFrame([(1, t, p) for t, p in ((0, 1), (5, 1), (6, 2), (12, 1), (13, 2), (14, 2))], "key long, t long, person long")
    iv = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 10, 20)], "key long, id long, s long, e long")
    assert rows(tracks.present(s, iv, 4), "id", "person", "n", "rank") == [(7, 1, 2, 1), (8, 2, 2, 1)]
    assert rows(tracks.rebased(s, iv, 4, 1), "id", "at") == [(7, 1), (7, 6), (7, 7), (8, 3), (8, 4), (8, 5)]


def test_focus(spark):
    clips = spark.createDataFrame([(1, 1, 0, 10, None), (1, 2, 10, 20, 3)], "key long, id long, s long, e long, person long")
    turns = spark.createDataFrame([(1, 0, 4, 1), (1, 4, 6, 3), (1, 6, 30, 3)], "key long, s long, e long, person long")
    assert rows(tracks.focus(clips, turns, 5), "person", "s", "e") == [(1, 0, 4), (3, 4, 20)]


def test_assigned(spark):
    links = spark.createDataFrame([(1, 0, 1, 0.8), (1, 0, 2, 1.4), (1, 1, 1, 1.3), (1, 1, 2, 0.7)], "key long, speaker long, person long, score double")
    assert rows(tracks.assigned(links, 1.15), "speaker", "person") == [(0, 2), (1, 1)]


def test_suppressed_and_linked(spark):
    b = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 50.0, 0.0, 10.0, 10.0, 0.7)], "key long, id long, x double, y double, w double, h double, score double")
    assert rows(tracks.suppressed(b, 0.3), "id") == [(1,), (3,)]
    f = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0), (1, 0, 2, 9.0, 0.0, 1.0), (1, 1, 3, 8.5, 0.0, 1.0), (1, 1, 4, 0.5, 0.0, 1.0), (1, 9, 5, 0.5, 0.0, 1.0)], "key long, k long, id long, x double, y double, w double")
    assert rows(tracks.linked(f, 2.5, 4), "id", "track") == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 5)]


def test_nearest_pairs_of_an_instant_come_first(spark):
    # by id the first face would take the track that the second one is nearer to
    f = spark.createDataFrame([(1, 0, 1, 0.0, 0.0, 1.0, [1.0, 0.0]), (1, 1, 2, 1.0, 0.0, 1.0, [1.0, 0.0]), (1, 1, 3, 0.2, 0.0, 1.0, [1.0, 0.0]), (1, 2, 4, 0.2, 0.0, 1.0, [0.0, 1.0]), (1, 2, 5, None, 0.0, 1.0, None)], "key long, k long, id long, x double, y double, w double, emb array<double>")
    assert rows(tracks.linked(f, 2.5, 4), "id", "track") == [(1, 1), (2, 2), (3, 1), (4, 1)]
    assert rows(tracks.linked(f, 2.5, 4, alike=0.2), "id", "track") == [(1, 1), (2, 2), (3, 1), (4, 4)]
    assert rows(tracks.linked(f, 2.5, 4, 2, 0.2), "id", "track") == [(1, 1), (3, 1)]
    assert rows(tracks.linked(f.where("id = 1"), 2.5, 4, 2), "id", "track") == [(1, 1)]


def test_zooms_plain_version(spark):
    rng, want, marks = random.Random(9), set(), []
    for key in range(30):
        times = sorted(rng.sample(range(30_000), rng.randint(1, 60)))
        end = times[-1] + rng.randint(1, 3000)
        marks += [(key, t, end) for t in times]
        at, side = times[0], 0
        while at < end:
            fit = [t for t in times if at + 1300 <= t < end - 300]
            upto = min(fit, key=lambda t: (abs(t - at - 1800), t)) if fit else end
            want.add((key, at, upto, side % 2))
            at, side = upto, side + 1
    assert set(rows(tracks.zooms(spark.createDataFrame(marks, "key long, t long, end long"), 1800, 1300, 300), "key", "s", "e", "side")) == want


def test_thinned_zooms_and_clips(spark):
    p = spark.createDataFrame([(1, t, t) for t in range(10)], "key long, t long, id long")
    assert rows(tracks.thinned(p, 3), "t") == [(0,), (4,), (8,)]
    m = spark.createDataFrame([(1, t, 10_000) for t in (0, 1000, 1900, 3500, 9900)], "key long, t long, end long")
    assert rows(tracks.zooms(m, 1800, 1300, 300), "s", "e", "side") == [(0, 1900, 0), (1900, 3500, 1), (3500, 10_000, 0)]
    c = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 20, 30), (1, 3, 34, 50)], "key long, id long, s long, e long")
    q = spark.createDataFrame([(1, 5, 14), (1, 6, 25), (1, 7, 32)], "key long, id long, t long")
    assert rows(tracks.nearest_clip(q, c), "id", "clip") == [(5, 1), (6, 2), (7, 2)]
    assert rows(tracks.halves(c)) == [(1, 20)]
    assert rows(tracks.split_at_clips(c, c, 2), "part", "s", "e", "n") == [(0, 0, 30, 2), (1, 34, 50, 1)]


def test_faces(spark):
    f = spark.createDataFrame([(1, 0, 1, 7, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 8, 20.0, 5.0, 10.0, 10.0), (1, 0, 3, 9, 90.0, 0.0, 1.0, 1.0), (1, 1, 4, 7, 0.0, 0.0, 12.0, 10.0)], "key long, k long, id long, person long, x double, y double, w double, h double")
    assert rows(tracks.largest(f), "person", "id") == [(7, 4), (8, 2), (9, 3)]
    assert rows(tracks.united_boxes(f), "k", "x", "y", "w", "h") == [(0, 0.0, 0.0, 30.0, 15.0), (1, 0.0, 0.0, 12.0, 10.0)]
    p = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, None), (1, 50, None)], "key long, t long, x double")
    assert [(t, round(x, 6)) for t, x in rows(tracks.steady(p, 3), "t", "x")] == [(0, 1.7), (1, 1.7), (2, 1.7)]


def test_short_islands(spark):
    w = spark.createDataFrame([(1, i, m) for i, m in enumerate([False, True, True, False, True])], "key long, i long, marked boolean")
    assert rows(tracks.short_islands(w, 3), "s", "e", "n") == [(1, 2, 2)]


def test_line_layout(spark):
    df = spark.createDataFrame([([5, 1, 5], 2), ([3, 3, 3, 3], 2), ([4], 3)], "w array<int>, n int")
    assert [r[0] for r in df.select(tracks.line_layout("w", "n")).collect()] == [[1], [2], []]


def test_merged_transcripts(spark):
    first = [("Voici", 0.8), ("deux", 0.95), ("bots", 0.2), ("rouges.", 0.7)]
    df = spark.createDataFrame([([{"w": w, "p": p} for w, p in first], "voici deux bottes rouges".split())], "a array<struct<w:string,p:double>>, b array<string>")
    got = df.select(F.explode(align.merge_transcripts("a", "b")).alias("x")).select("x.*").collect()
    assert [r["v"] for r in got] == [0, 0, 1, 0] and (got[2]["w"], got[2]["alt"]) == ("bottes", "bots")
    words = [{"w": w, "p": p} for w, p in (("la", 0.9), ("lant", 0.2), ("erne", 0.3), ("bleue", 0.8))]
    out = align.merged_words(words, "la lanterne bleue".split())
    assert (out[1]["alt"], out[1]["altn"]) == ("lanterne", 2)


def test_speakers_and_persons_with_the_fallback(spark):
    rows = [
        (1, 1, 10, 1.5, 0.1, 0.5),  # the most moving lips first
        (1, 2, 10, 1.4, 0.9, 0.5),
        (1, 2, 11, 1.2, 0.0, 0.5),
        (1, 3, 10, None, 0.9, 0.9),  # alone, but taken
        (1, 3, 12, 1.0, 0.7, 0.2),
        (1, 3, 13, 1.1, 0.7, 0.2),  # equally alone: the larger person
        (1, 4, 14, 1.1, 0.5, 0.9),
        (2, 7, 20, 1.9, 0.9, 0.2),  # the only speaker goes by what is seen
        (2, 7, 21, None, None, 0.4),
        (3, 1, 5, None, None, 0.29),
        (4, 1, None, 2.0, 1.0, 1.0),
        (None, 1, 6, 1.15, None, None),
        (None, 2, 6, 1.15, 0.6, None),
        (None, 2, 7, None, 0.6, None),
    ]
    df = spark.createDataFrame(rows, "key long, speaker long, person long, lips double, alone double, seen double").repartition(3)
    got = sorted((str(r["key"]), r["speaker"], r["person"]) for r in tracks.speakers_shown(df).collect())
    assert got == [("1", 1, 10), ("1", 2, 11), ("1", 3, 13), ("2", 7, 21), ("None", 1, 6), ("None", 2, 7)]
    assert tracks.speakers_shown(df.limit(0)).count() == 0
