"""The limiter against a plain version, whatever the blocks; signals brought to a loudness."""

from __future__ import annotations

import math

import numpy as np
import pytest

from tidemark.operators import limiter, signal

RATE = 8000


def plain_limited(x, ceiling):
    """Sample by sample over the whole signal."""
    look, taps = max(1, int(RATE * 0.005)), 12
    bank = signal.interpolator(4, taps)
    padded = np.concatenate((np.zeros(taps - 1), x))
    want = np.ones(len(x))
    for f in range(len(x)):
        around = padded[f : f + taps][::-1]
        peak = max(abs(x[f]), max(abs(float(np.dot(phase, around))) for phase in bank))
        if peak > ceiling:
            for k in range(max(0, f - taps), f + 1):
                want[k] = min(want[k], ceiling / peak)
    gain, out = 1.0, []
    for t in range(len(x)):
        target = want[t : t + look + 1].min()
        gain = max(gain - 1 / look, target) if target < gain else target + (gain - target) * math.exp(-1 / (RATE * 0.08))
        out.append(min(ceiling, max(-ceiling, x[t] * gain)))
    return np.array(out)


def noise(n=3000):
    rng = np.random.default_rng(4)
    return np.sin(np.arange(n) / 3) * 0.4 + rng.normal(0, 0.05, n) + np.where(np.arange(n) % 700 == 650, 1.5, 0.0)


def blocks(spark, signals, size):
    rows = [(key, k, x[i : i + size].tolist()) for key, x in signals.items() for k, i in enumerate(range(0, max(1, len(x)), size))]
    return spark.createDataFrame(rows, "key long, n long, samples array<double>").repartition(3)


def joined(df):
    out: dict = {}
    for r in df.orderBy("key", "n").collect():
        out.setdefault(r["key"], []).extend(r["samples"])
    return out


@pytest.mark.parametrize("size", [1, 33, 640, 10_000])
def test_the_same_for_every_block(spark, size):
    x = noise()
    if size == 1:
        x = x[600:760]
    got = joined(limiter.limited(blocks(spark, {1: x, 2: -x[:50], None: x[:3]}, size), RATE, 0.6))
    for key, own in ((1, x), (2, -x[:50]), (None, x[:3])):
        np.testing.assert_allclose(got[key], plain_limited(own, 0.6), atol=1e-9)


def test_gain_falls_before_a_peak_of_the_next_block(spark):
    x = np.full(200, 0.1)
    x[100] = 1.0
    got = np.array(joined(limiter.limited(blocks(spark, {1: x}, 100), RATE, 0.5))[1])
    assert (got[95:100] < 0.09).all() and abs(got[:40] - 0.1).max() < 1e-12


def test_rows_without_samples(spark):
    df = spark.createDataFrame([(1, 0, [0.5, 2.0]), (1, 1, None), (1, 2, []), (2, 0, None)], "key long, n long, samples array<double>")
    got = {(r["key"], r["n"]): len(r["samples"]) for r in limiter.limited(df, RATE, 0.7).collect()}
    assert got == {(1, 0): 2, (1, 1): 0, (1, 2): 0, (2, 0): 0}
    assert limiter.limited(df.limit(0), RATE, 0.7).count() == 0


def test_loudness_is_reached(spark):
    t = np.arange(RATE * 2) / RATE
    quiet, loud = 0.02 * np.sin(2 * np.pi * 440 * t), 0.9 * np.sin(2 * np.pi * 300 * t)
    peaky = 0.01 * np.sin(2 * np.pi * 500 * t) + np.where(np.arange(len(t)) % 2000 == 0, 0.5, 0.0)
    signals = blocks(spark, {1: quiet, 2: loud, 3: np.zeros(RATE), 4: peaky}, RATE // 10)
    now, told = limiter.normalised(signals, RATE, -16.0, -1.0)
    got = {r["key"]: r for r in told.collect()}
    for key in (1, 2):
        assert abs(got[key]["after"] + 16) < 0.3 and got[key]["peak_db"] <= -0.9
    assert got[3]["before"] == -math.inf and got[3]["after"] == -math.inf
    assert got[4]["peak_db"] <= -0.9 and got[4]["passes"] <= 5 and got[4]["after"] > got[4]["before"]
    assert {k: len(v) for k, v in joined(now).items()} == {1: 2 * RATE, 2: 2 * RATE, 3: RATE, 4: 2 * RATE}
    assert max(map(abs, joined(now)[3])) == 0
