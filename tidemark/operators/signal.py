"""Signals as rows of blocks (key, n, samples): levels, K-weighted loudness with gates, true peaks, spectra, limiting.

Kernels run per key in order of blocks; a worker holds one block and a filter's state at a time, never a whole signal.
What they give, a row for each 100 ms, goes through the gates of `series` and SQL aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window


def by_blocks(signal: DataFrame, outputs: str, start: Callable, step: Callable) -> DataFrame:
    """(key, n, …): step(state, samples) -> (state, outputs) over the blocks of each key in order."""
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*signal.select("key", "n").schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, object()
        for batch in batches:
            found = []
            for k, key in enumerate(batch.column("key").to_pylist()):
                if key != last:
                    state, last = start(), key
                x = np.asarray(batch.column("samples")[k].values.to_numpy(zero_copy_only=False), float) if batch.column("samples")[k].is_valid else np.zeros(0)
                state, out = step(state, x)
                found.append(out)
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], schema.names)

    return signal.select("key", "n", "samples").repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, schema)


def levels(signal: DataFrame) -> DataFrame:
    """(key, n, rms_db, peak, clipped): level, largest sample and samples at full scale of each block."""
    x = lambda f, zero: F.aggregate("samples", F.lit(zero), f)
    energy = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")) / F.size("samples")
    peak = x(lambda s, v: F.greatest(s, F.abs(v.cast("double"))), 0.0)
    clipped = F.size(F.filter("samples", lambda v: F.abs(v) >= 32767 / 32768))
    return signal.select("key", "n", (20 * F.log10(F.sqrt(energy) + 1e-6)).alias("rms_db"), peak.alias("peak"), clipped.alias("clipped"))


def prefilter(rate: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The high shelf of K weighting for a sample rate (constants of ITU-R BS.1770)."""
    f0, gain, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k = math.tan(math.pi * f0 / rate)
    vh = 10 ** (gain / 20)
    vb = vh**0.4996667741545416
    a0 = 1 + k / q + k * k
    return ((vh + vb * k / q + k * k) / a0, 2 * (k * k - vh) / a0, (vh - vb * k / q + k * k) / a0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)


def high_pass(rate: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """The high pass of K weighting for a sample rate (constants of ITU-R BS.1770)."""
    f0, q = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f0 / rate)
    a0 = 1 + k / q + k * k
    return (1.0, -2.0, 1.0), (2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0)


def biquad(coefficients, state: list[float], x: np.ndarray) -> np.ndarray:
    """One second-order section, transposed; the state is carried on."""
    (b0, b1, b2), (a1, a2) = coefficients
    z1, z2 = state
    out = np.empty(len(x))
    for k, v in enumerate(x.tolist()):
        y = b0 * v + z1
        z1 = b1 * v - a1 * y + z2
        z2 = b2 * v - a2 * y
        out[k] = y
    state[:] = [z1, z2]
    return out


def weighted_energy(signal: DataFrame, rate: int) -> DataFrame:
    """(key, n, energy): mean K-weighted energy of each block."""
    shelf, cut = prefilter(rate), high_pass(rate)

    def step(state, x):
        y = biquad(cut, state[1], biquad(shelf, state[0], x))
        return state, (float((y * y).mean()) if len(y) else 0.0,)

    return by_blocks(signal, "energy double", lambda: [[0.0, 0.0], [0.0, 0.0]], step)


def loudness(energies: DataFrame) -> DataFrame:
    """(key, lufs, range_lu): integrated loudness and loudness range of 100 ms energies: windows of 400 ms and 3 s, the gates
    at -70 LUFS and 10 (range: 20) below the mean above it, ranks 0.10 and 0.95."""
    w = Window.partitionBy("key").orderBy("n")
    k = F.row_number().over(w)
    level = lambda e: -0.691 + 10 * F.log10(e)
    rows = energies.select("key", *[F.when(k >= n, F.avg("energy").over(w.rowsBetween(1 - n, 0))).alias(f"e{n}") for n in (4, 30)])

    def gated(column: str, below: float) -> DataFrame:
        loud = rows.where((F.col(column) > 0) & (level(F.col(column)) >= -70)).select("key", F.col(column).alias("e"))
        gate = level(F.avg("e").over(Window.partitionBy("key"))) - below
        return loud.withColumn("gate", gate).where(level(F.col("e")) >= F.col("gate"))

    whole = gated("e4", 10).groupBy("key").agg(level(F.avg("e")).alias("lufs"))
    ranks = gated("e30", 20).select("key", level(F.col("e")).alias("l"))
    spread = ranks.groupBy("key").agg((F.percentile("l", 0.95) - F.percentile("l", 0.10)).alias("range_lu"))
    keys = energies.select("key").distinct()
    return keys.join(whole, "key", "left").join(spread, "key", "left").select("key", F.coalesce("lufs", F.lit(float("-inf"))).alias("lufs"), F.coalesce("range_lu", F.lit(0.0)).alias("range_lu"))


@cache
def interpolator(times: int = 4, taps: int = 12) -> np.ndarray:
    """Windowed-sinc phases for reading a signal at `times` its rate."""
    n = times * taps
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / times) * np.kaiser(n, 8.0)
    return h.reshape(taps, times).T / h.reshape(taps, times).sum(axis=0)[:, None]


def true_peaks(signal: DataFrame, times: int = 4, taps: int = 12) -> DataFrame:
    """(key, n, peak): the largest absolute value of each block read at four times its rate, across block borders."""
    bank = interpolator(times, taps)

    def step(before, x):
        joined = np.concatenate((before, x))
        peak = max((float(np.abs(np.convolve(joined, phase)[taps - 1 :]).max(initial=0)) for phase in bank), default=0.0) if len(x) else 0.0
        return joined[-(taps - 1) :], (peak,)

    return by_blocks(signal, "peak double", lambda: np.zeros(taps - 1), step)


def limited(signal: DataFrame, ceiling: float, rate: int, ahead: float = 0.005, release: float = 0.05) -> DataFrame:
    """(key, n, samples): gain that falls before a sample over the ceiling and comes back slowly; each block looks ahead
    inside itself and carries the gain on."""
    look, back = max(1, int(ahead * rate)), math.exp(-1 / (release * rate))

    def step(gain, x):
        need = np.minimum(1.0, ceiling / np.maximum(np.abs(x), 1e-12))
        if not len(x):
            return gain, ([],)
        padded = np.concatenate((need, np.ones(look)))
        least = np.lib.stride_tricks.sliding_window_view(padded, look + 1).min(axis=1)
        out = np.empty(len(x))
        for k, target in enumerate(least.tolist()):
            gain = target if target < gain else target + (gain - target) * back
            gain = min(gain, float(need[k]))
            out[k] = gain
        return gain, ((x * out).astype(np.float32).tolist(),)

    return by_blocks(signal, "samples array<float>", lambda: 1.0, step)


@cache
def mel_filters(rate: int, size: int, bands: int) -> np.ndarray:
    """Triangles on the mel scale (linear to 1 kHz, logarithmic above), of equal area."""
    step = math.log(6.4) / 27
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) / step
    hertz = lambda m: m * 200 / 3 if m < 15 else 1000 * math.exp((m - 15) * step)
    edges = np.array([hertz(m) for m in np.linspace(0, mel(rate / 2), bands + 2)])
    f = np.fft.rfftfreq(size, 1 / rate)
    up, down = (f[None] - edges[:-2, None]) / np.diff(edges)[:-1, None], (edges[2:, None] - f[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def cepstra(signal: DataFrame, rate: int, size: int = 512, bands: int = 40, keep: int = 20) -> DataFrame:
    """(key, n, mfcc): cosine transform of the log mel energies of each block's mean spectrum."""
    bank = mel_filters(rate, size, bands)
    basis = np.cos(np.pi * np.outer(np.arange(keep), np.arange(bands) + 0.5) / bands)

    def step(state, x):
        x = np.concatenate((x, np.zeros(max(0, size - len(x)))))
        frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: size // 2] * np.hanning(size)
        power = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).mean(axis=0)
        return state, ((basis @ np.log(bank @ power + 1e-10)).tolist(),)

    return by_blocks(signal, "mfcc array<double>", lambda: None, step)


def band_energies(signal: DataFrame, rate: int, split_hz: float) -> DataFrame:
    """(key, n, low, high): energies below and above a frequency."""

    def step(state, x):
        power = np.abs(np.fft.rfft(x)) ** 2 if len(x) else np.zeros(1)
        f = np.fft.rfftfreq(max(1, len(x)), 1 / rate)[: len(power)]
        return state, (float(power[f < split_hz].sum()), float(power[f >= split_hz].sum()))

    return by_blocks(signal, "low double, high double", lambda: None, step)
