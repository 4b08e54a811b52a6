"""A limiter that looks ahead across blocks, and signals brought to a loudness by repeated gain and limiting.

A signal (key, n, samples) is read in order; what a sample's gain depends on, its peaks up to the end of the look-ahead, is
waited for, so a block leaves once as much of the following ones has come as it needs: the result is the same for every
size of blocks, and a worker holds the blocks that wait. Bringing signals to a loudness is an iteration to a fixed point over
stored tables: each round moves the signals that aren't settled, measures them, and decides for each what comes next.

Defined cases. Null samples are no block's samples: the block comes back empty. Rows of one n go in any order. A silent signal,
or one without samples, is left as it is. Empty tables give empty results."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources import work

from . import signal as signals

#: Seconds of look-ahead and of release, and how a signal is read between its samples.
AHEAD, RELEASE, TIMES, TAPS = 0.005, 0.08, 4, 12


class Limiter:
    """One signal's gain: it falls in a line before a peak that is over the ceiling between samples, and comes back slowly."""

    def __init__(self, ceiling: float, rate: int) -> None:
        self.ceiling, self.gain = ceiling, 1.0
        self.look = max(1, int(rate * AHEAD))
        self.back = math.exp(-1 / (rate * RELEASE))
        self.before = np.zeros(TAPS - 1)
        self.waiting = np.zeros(0)  # samples that have no gain yet
        self.need = np.zeros(0)  # the gain that each of them needs by itself
        self.blocks: list[list] = []  # number, length, samples done

    def needed(self, x: np.ndarray) -> np.ndarray:
        joined = np.concatenate((self.before, x))
        peak = np.abs(x)
        for phase in signals.interpolator(TIMES, TAPS):
            peak = np.maximum(peak, np.abs(np.convolve(joined, phase)[TAPS - 1 : TAPS - 1 + len(x)]))
        self.before = joined[len(joined) - (TAPS - 1) :]
        return np.where(peak > self.ceiling, self.ceiling / np.maximum(peak, 1e-30), 1.0)

    def feed(self, n, x: np.ndarray) -> Iterator[tuple]:
        self.blocks.append([n, len(x), []])
        if len(x):
            self.need = np.concatenate((self.need, self.needed(x)))
            self.waiting = np.concatenate((self.waiting, x))
        return self.done(len(self.waiting) - self.look - TAPS)

    def finish(self) -> Iterator[tuple]:
        return self.done(len(self.waiting))

    def done(self, ready: int) -> Iterator[tuple]:
        """Blocks whose samples are all among the first `ready` that wait."""
        if ready > 0:
            reach = self.look + TAPS
            padded = np.concatenate((self.need, np.ones(max(0, ready + reach - len(self.need)))))
            target = np.lib.stride_tricks.sliding_window_view(padded, reach + 1)[:ready].min(axis=1)
            y = np.clip(self.waiting[:ready] * self.gains(target), -self.ceiling, self.ceiling)
            self.waiting, self.need = self.waiting[ready:], self.need[ready:]
            for block in self.blocks:
                take = min(len(y), block[1] - sum(map(len, block[2])))
                block[2].append(y[:take])
                y = y[take:]
        while self.blocks and sum(map(len, self.blocks[0][2])) == self.blocks[0][1]:
            n, _, some = self.blocks.pop(0)
            yield n, np.concatenate([*some, np.zeros(0)])

    def gains(self, target: np.ndarray) -> np.ndarray:
        if self.gain > 1 - 1e-9 and target.min() >= 1:
            return np.ones(len(target))
        gain, step, back = self.gain, 1 / self.look, self.back
        out = np.empty(len(target))
        for k, wanted in enumerate(target.tolist()):
            gain = max(gain - step, wanted) if wanted < gain else wanted + (gain - wanted) * back
            out[k] = gain
        self.gain = gain
        return out


def limited(signal: DataFrame, rate: int, ceiling: float | None = None) -> DataFrame:
    """(key, n, samples): true peaks (at four times the rate) held under `ceiling`, or under each row's column `ceiling`, of
    which a key has one; a null ceiling leaves a key as it is."""
    rows = signal.select("key", "n", "samples", (F.lit(ceiling) if ceiling is not None else F.col("ceiling")).cast("double").alias("ceiling"))
    kind = dict(signal.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last, key_type = None, object(), None
        for batch in batches:
            key_type = batch.column("key").type
            out: list[tuple] = []
            for k, (key, n, top) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ceiling")), strict=True)):
                if key != last:
                    out += [(last, *block) for block in state.finish()] if state else []
                    state, last = Limiter(math.inf if top is None else top, rate), key
                told = batch.column("samples")[k]
                x = np.asarray(told.values.to_numpy(zero_copy_only=False), float) if told.is_valid else np.zeros(0)
                out += [(key, *block) for block in state.feed(n, x)]
            yield packed(out, key_type)
        if state:
            yield packed([(last, *block) for block in state.finish()], key_type)

    def packed(out: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], key_type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], ["key", "n", "samples"])

    return rows.withColumn("n", F.col("n").cast("long")).repartition("key").sortWithinPartitions("key", "n").mapInArrow(run, f"key {kind}, n long, samples array<double>")


def measured(signal: DataFrame, rate: int) -> DataFrame:
    """(key, lufs, peak_db): loudness and true peak of each signal."""
    loud = signals.loudness(signals.weighted_energy(signal, rate)).select("key", "lufs")
    peak = signals.true_peaks(signal, TIMES, TAPS).groupBy(F.col("key").alias("_key")).agg((20 * F.log10(F.greatest(F.max("peak"), F.lit(1e-30)))).alias("peak_db"))
    return loud.join(peak, F.col("key").eqNullSafe(F.col("_key"))).select("key", "lufs", "peak_db")


#: Rounds of gain, tries of a lower ceiling in each; decibels that a later round adds at most, that count as met, and by which
#: a true peak may pass the ceiling.
PASSES, TRIES, MOST_GAIN, NEAR, SLACK = 5, 4, 6.0, 0.2, 0.05


def normalised(signal: DataFrame, rate: int, target: float, ceiling: float) -> tuple[DataFrame, DataFrame]:
    """Signals (key, n, samples) brought to `target` LUFS with true peaks under `ceiling` dB, and (key, before, after, peak_db,
    passes). A gain, then the limiter, whose ceiling is lowered while peaks between samples pass; up to PASSES times, as long
    as the loudness isn't near."""
    spark = signal.sparkSession

    def stored(df: DataFrame, what: str) -> DataFrame:
        path = work.folder(spark, what)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    now = stored(signal.select("key", F.col("n").cast("long").alias("n"), F.col("samples").cast("array<double>").alias("samples")), "loudness")
    start = measured(now, rate)
    heard = F.col("lufs") > float("-inf")
    state = stored(
        start.select("key", F.col("lufs").alias("before"), F.col("lufs").alias("after"), "peak_db", F.lit(1).alias("passes"), F.lit(1).alias("tries"), F.lit(float(ceiling)).alias("top"), F.when(heard, F.lit(target) - F.col("lufs")).otherwise(0.0).alias("gain"), (~heard).alias("settled")),
        "loudness-state",
    )
    for _ in range(PASSES * TRIES):
        if not state.where(~F.col("settled")).limit(1).count():
            break
        told = now.join(state.select(F.col("key").alias("_key"), "gain", "top", "settled"), F.col("key").eqNullSafe(F.col("_key")))
        factor = F.pow(F.lit(10.0), F.col("gain") / 20)
        moved = told.select("key", "n", F.when(F.col("settled"), F.col("samples")).otherwise(F.transform("samples", lambda x: x * factor)).alias("samples"), F.when(~F.col("settled"), F.pow(F.lit(10.0), F.col("top") / 20)).alias("ceiling"))
        now = stored(limited(moved, rate), "loudness")
        got = measured(now, rate).select(F.col("key").alias("_key"), F.col("lufs").alias("_lufs"), F.col("peak_db").alias("_peak"))
        s = state.join(got, F.col("key").eqNullSafe(F.col("_key")))
        over = F.col("_peak") - ceiling
        ended = (over <= SLACK) | (F.col("tries") >= TRIES)
        wanted = F.when(F.col("_lufs") > float("-inf"), F.lit(target) - F.col("_lufs")).otherwise(0.0)
        met = ended & ((F.col("passes") >= PASSES) | (F.abs(wanted) < NEAR))
        keep = F.col("settled")
        state = stored(
            s.select(
                "key",
                "before",
                F.when(keep, F.col("after")).otherwise(F.col("_lufs")).alias("after"),
                F.when(keep, F.col("peak_db")).otherwise(F.col("_peak")).alias("peak_db"),
                F.when(keep | met | ~ended, F.col("passes")).otherwise(F.col("passes") + 1).alias("passes"),
                F.when(ended, F.lit(1)).otherwise(F.col("tries") + 1).alias("tries"),
                F.when(ended, F.lit(float(ceiling))).otherwise(F.col("top") - over - 0.1).alias("top"),
                F.when(ended, F.least(wanted, F.lit(MOST_GAIN))).otherwise(F.lit(0.0)).alias("gain"),
                (keep | met).alias("settled"),
            ),
            "loudness-state",
        )
    return now, state.select("key", "before", "after", "peak_db", "passes")
