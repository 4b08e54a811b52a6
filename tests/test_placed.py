"""Places, shapes and digests against plain versions and on awkward rows."""

from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators import placed


def test_words_in_their_segment(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for key in range(120):
        s, e = 1000, 1000 + rng.randrange(0, 2500)
        words = [(i, rng.choice(["a", "house", "antidisestablishment", "…", None]), rng.randrange(200, 3500)) for i in range(rng.randrange(1, 9))]
        if key % 2:
            words = [(i, w, a) for (i, w, _), a in zip(words, sorted(x[2] for x in words))]
        b = rng.choice([None, 2500])
        starts, piled = [], True
        for k, (i, w, a) in enumerate(words):
            least = min(250, max(80, 40 * sum(c.isalnum() for c in (words[k - 1][1] or "")))) if k else 0
            earliest = s if k == 0 else starts[-1] + least if piled else starts[-1]
            piled = piled and a < s
            starts.append(min(e, max(a, earliest)))
        ends = [*starts[1:], min(e, max(b if b is not None else starts[-1], starts[-1] + 300))]
        for (i, w, a), x, y in zip(words, starts, ends):
            rows.append((key, 1, i, w, a, b, s, e))
            want[key, i] = (x, y)
    rows.append((999, 1, 0, "x", None, 1, 0, 9))
    df = spark.createDataFrame(rows, "key long, segment long, i long, w string, a long, b long, s long, e long").repartition(3)
    assert {(r["key"], r["i"]): (r["start"], r["end"]) for r in placed.placed_in_segment(df).collect()} == want
    assert placed.placed_in_segment(df.limit(0)).count() == 0


def test_shapes(spark):
    df = spark.createDataFrame([(1, 0, 10), (1, 1, 0), (1, 2, 5), (2, 0, 0), (None, 0, 3), (3, 0, None)], "key long, n long, peak long")
    assert {(r["key"], r["n"]): r["height"] for r in placed.waveform(df).collect()} == {(1, 0): 100, (1, 1): 0, (1, 2): 66, (2, 0): 0, (None, 0): 100, (3, 0): None}


def test_frames(spark):
    df = spark.createDataFrame([(1, 9.0, [1.0, 2.0]), (2, 0.0, []), (3, None, None), (4, 60.0, [float(k) for k in range(60)])], "id long, d double, cuts array<double>")
    got = {r["id"]: r["t"] for r in df.select("id", placed.frame_times(F.col("d"), F.col("cuts")).alias("t")).collect()}
    assert len(got[1]) == 20 and {0.25, 1.15, 2.15} <= set(got[1]) and got[1] == sorted(got[1])
    assert got[2] == [0.0] and got[3] == [0.0] and len(got[4]) == 36 and {0.15, 17.15} <= set(got[4])


def test_captions_in_clips(spark):
    captions = spark.createDataFrame([(1, 1, 5, 30), (1, 2, 25, 26), (1, 3, 99, 120), (2, 4, 5, 30), (1, 5, None, 7)], "key long, id long, s long, e long")
    clips = spark.createDataFrame([(1, 7, 0, 10), (1, 8, 3, 28), (1, 9, 30, 20), (1, 6, None, 4)], "key long, id long, s long, e long")
    for width in (4, 1000):
        got = {r["id"]: (r["e"], r["clip"]) for r in placed.in_clips(captions, clips, width).collect()}
        assert got == {1: (10, 7), 2: (26, 8), 3: (120, None), 4: (30, None), 5: (7, None)}


def test_nearest_word_is_never_the_first(spark):
    words = spark.createDataFrame([(1, 1, 0), (1, 2, 10), (1, 3, 20), (2, 1, 5), (1, 4, None)], "key long, i long, a long")
    cuts = spark.createDataFrame([(1, 1, 0), (1, 2, 15), (1, 3, 99), (2, 4, 5)], "key long, id long, t long")
    assert {r["id"]: r["word"] for r in placed.nearest_word(cuts, words).collect()} == {1: 2, 2: 2, 3: 3, 4: None}


def test_scores(spark):
    frames = spark.createDataFrame([(1, 0, 60.0, 1.0), (1, 0, 50.0, 3.0), (1, 0, 10.0, 900.0), (1, 1, 60.0, 5.0)], "key long, k int, energy double, x double")
    chunks = spark.createDataFrame([(1, 7, 0, 4.0, 2.0), (1, 7, 1, 5.0, 0.0)], "key long, id long, k int, mean double, deviation double")
    assert {r["k"]: (r["mean"], r["deviation"]) for r in placed.scored(chunks, frames).collect()} == {0: (2.0, 2.0), 1: (0.0, 0.0)}


def test_digests(spark):
    r = spark.createDataFrame([("é", "p", None)], "a string, b string, c string").select(placed.digest(F.col("a")), placed.content_id(F.col("a")), placed.part_key(F.col("a"), F.col("b")), placed.part_key(F.col("a"), F.col("c")), placed.digest(F.col("c"))).first()
    sha = lambda h, t: h(t.encode()).hexdigest()[:16]
    assert tuple(r) == (sha(hashlib.sha1, "é"), sha(hashlib.sha256, "é"), sha(hashlib.sha1, "ép"), sha(hashlib.sha1, "é"), None)


@pytest.mark.parametrize("big", [1, 10**12])
def test_fractions(spark, big):
    rng = random.Random(big)
    rows = [(k, rng.randrange(-50, 50) * big + rng.randrange(3), rng.randrange(1, 9), rng.randrange(-5, 6), rng.randrange(1, 5)) for k in range(200)]
    got = {r["k"]: r for r in spark.createDataFrame(rows, "k long, n long, d long, m long, q long").select("k", placed.floor_divided(F.col("n"), F.col("d"), F.col("m"), F.col("q")).alias("f"), placed.rounded_fraction(F.col("n"), F.col("d")).alias("r")).collect()}
    for k, n, d, m, q in rows:
        assert got[k]["f"] == (None if m == 0 else Fraction(n, d) // Fraction(m, q)) and got[k]["r"] == round(Fraction(n, d))
