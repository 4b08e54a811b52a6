"""Folds: what depends on all earlier choices of the same key, read once in order.

Rows are dealt by key and sorted inside each task; Python walks the sorted batches and carries a small state from row to
row, so no key is ever gathered. Where a fold starts anew at a pause, the key holds the pause's session too, so that a key
with very many rows is dealt over many tasks.

Defined cases. Rows without a time (or a bound, a value, a strength where it counts) are left out; a null key is a key of its
own; rows of one time are read by id, and equal rows may change places. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .islands import pause_runs


def fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], outputs: str, start: Callable[[], Any], step: Callable[..., tuple[Any, tuple]]) -> DataFrame:
    """Each row's keys, order columns and inputs with the outputs of `step(state, *order and inputs) -> (state, outputs)`."""
    columns = [*keys, *[c for c in order if c not in keys], *[c for c in inputs if c not in order and c not in keys]]
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([*df.select(*columns).schema.fields, *added.fields])
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    passed = columns[len(keys) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, object()
        for batch in batches:
            own = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            rows = zip(*[batch.column(c).to_pylist() for c in passed], strict=True)
            found = []
            for key, row in zip(own, rows, strict=True):
                if key != last:
                    state, last = start(), key
                state, out = step(state, *row)
                found.append(out)
            new = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(new, kinds, strict=True)]], names=schema.names)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def capped_chunks(points: DataFrame, pause: int, span: int) -> DataFrame:
    """(key, chunk, s, e, n): a pause of at least `pause`, or a span of more than `span` since the chunk's start, opens a new
    chunk. `chunk` is the time of its first row."""

    def step(first, t, id_):
        first = t if first is None or t - first > span else first
        return first, (first,)

    sessions = pause_runs(points.where("t is not null").select("key", "id", "t"), pause)
    placed = fold(sessions, ["key", "session"], ["t", "id"], [], "chunk long", lambda: None, step)
    return placed.groupBy("key", "chunk").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


def packed(iv: DataFrame, most: int, between: int) -> DataFrame:
    """(key, id, bin): consecutive intervals put into a bin while their lengths and `between` for each further one fit."""

    def step(state, s, id_, e):
        number, used = state
        need = e - s
        if number and used + between + need <= most:
            state = (number, used + between + need)
        else:
            state = (number + 1, need)
        return state, (state[0],)

    return fold(iv.where("s is not null and e is not null"), ["key"], ["s", "id"], ["e"], "bin long", lambda: (0, 0), step).select("key", "id", "bin")


def spaced(points: DataFrame, least: int) -> DataFrame:
    """(key, id, t, at): times moved forward so that each is at least `least` after the one before.

    A closed form: the r-th row comes `least` times r after the latest that any row up to it asks for, so one window does."""
    w = Window.partitionBy("key").orderBy("t", "id")
    placed = points.where("t is not null").select("key", "t", "id", F.row_number().over(w).cast("long").alias("r"))
    asks = F.max(F.col("t") - least * F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select("key", "t", "id", (least * F.col("r") + asks).alias("at"))


def ewma(points: DataFrame, value: str, old: float = 0.3, new: float = 0.7) -> DataFrame:
    """(key, id, t, rate): the learned rate after each observation; the first one is taken as it is."""

    def step(rate, t, id_, v):
        rate = float(v) if rate is None else old * rate + new * v
        return rate, (rate,)

    return fold(points.where(F.col("t").isNotNull() & F.col(value).isNotNull()), ["key"], ["t", "id"], [value], "rate double", lambda: None, step).select("key", "id", "t", "rate")


def content_chunks(points: DataFrame, least: int, most: int) -> DataFrame:
    """(key, chunk, s, n, print): cut before a row whose id hashes to an even first byte once `least` time has gone by, and
    in any case before `most` would be passed; the print tells whether a chunk has changed."""

    def step(first, t, id_):
        even = int(hashlib.sha1(str(id_).encode()).hexdigest()[:2], 16) % 2 == 0
        if first is None or t - first > most or (even and t - first >= least):
            first = t
        return first, (first,)

    placed = fold(points.where("t is not null"), ["key"], ["t", "id"], [], "chunk long", lambda: None, step)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "id"))), lambda x: x["id"].cast("string")), ",")
    return placed.groupBy("key", "chunk").agg(F.count("*").alias("n"), F.substring(F.sha1(text.cast("binary")), 1, 16).alias("print"))


def refractory(events: DataFrame, rest: int) -> DataFrame:
    """Rows (key, t, id) that come at least `rest` after the last kept one.

    A pause of `rest` before a row keeps it whatever came before, so the fold starts anew there."""

    def step(kept, t, id_):
        keep = kept is None or t - kept >= rest
        return (t if keep else kept), (keep,)

    sessions = pause_runs(events.where("t is not null").select("key", "t", "id"), rest)
    return fold(sessions, ["key", "session"], ["t", "id"], [], "kept boolean", lambda: None, step).where("kept").select("key", "t", "id")


def strongest_apart(events: DataFrame, rest: int) -> DataFrame:
    """Rows (key, t, id, strength) kept strongest first where none stronger within `rest` is kept.

    Only rows closer than `rest` in a chain can touch each other: chains are the sessions, and each is walked by strength."""

    def step(kept, less, t, id_):
        keep = all(abs(t - k) >= rest for k in kept)
        return (kept + [t] if keep else kept), (keep,)

    sessions = pause_runs(events.where("t is not null and strength is not null").select("key", "t", "id", "strength"), rest).withColumn("less", -F.col("strength"))
    return fold(sessions, ["key", "session"], ["less", "t", "id"], ["strength"], "kept boolean", list, lambda k, a, b, c, d: step(k, a, b, c)).where("kept").select("key", "t", "id", "strength")


def held_turns(runs: DataFrame, least: int) -> DataFrame:
    """(key, run, spk, s, e): runs (key, run, spk, s, n) shorter than `least` rows go to the turn before them, equal
    neighbours join, and a short first one goes to the one after; a turn ends where the next one starts, the last never. A
    null n counts as 0."""

    def step(state, run, spk, s, n):
        number, speaker, short_first = state
        n = n or 0
        if number == 0:
            state = (1, spk, n < least)
        elif n >= least and short_first:
            state = (number, spk, False)
        elif n >= least and spk != speaker:
            state = (number + 1, spk, False)
        else:
            state = (number, speaker, short_first)
        return state, (state[0],)

    placed = fold(runs, ["key"], ["run"], ["spk", "s", "n"], "turn long", lambda: (0, None, False), step)
    # a turn speaks with the voice of its first long run, or of its first one where all are short
    voice = F.min(F.struct((F.coalesce("n", F.lit(0)) < least).cast("int").alias("short"), "run", "spk")).alias("v")
    held = placed.groupBy("key", "turn").agg(F.min("s").alias("s"), voice)
    following = F.lead("s").over(Window.partitionBy("key").orderBy("turn"))
    return held.select("key", "turn", F.col("v.spk").alias("spk"), F.col("s").cast("double").alias("s"), F.coalesce(following.cast("double"), F.lit(float("inf"))).alias("e"))
