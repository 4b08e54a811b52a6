"""Interval algebra on rows (key, id, s, e) with integer bounds: gaps, unions, offsets, overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import asof

ORDER = ("s", "e", "id")


def gaps(iv: DataFrame, least: int, first_id: int = 1000) -> DataFrame:
    """(key, gap_id, s, e): stretches of at least `least` that no earlier interval of the key covers, before its next one."""
    w = Window.partitionBy("key").orderBy(*ORDER)
    seen = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    found = iv.select("key", "id", seen.alias("from"), F.col("s").alias("to")).where(F.col("to") - F.col("from") >= least)
    number = F.row_number().over(Window.partitionBy("key").orderBy("to", "id"))
    return found.select("key", (number + (first_id - 1)).cast("long").alias("gap_id"), F.col("from").alias("s"), F.col("to").alias("e"))


def gaps_head_tail(iv: DataFrame, first: int | Column, total: int | Column, least: int) -> DataFrame:
    """Gaps with those before a key's first interval and after its last."""
    ends = iv.groupBy("key").agg(F.min("s").alias("first"), F.max("e").alias("last"))
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    head = ends.select("key", lit(first).cast("long").alias("s"), F.col("first").alias("e"))
    tail = ends.select("key", F.col("last").alias("s"), lit(total).cast("long").alias("e"))
    every = gaps(iv, least).select("key", "s", "e").unionByName(head).unionByName(tail).where(F.col("e") - F.col("s") >= least)
    return every.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("s", "e")) + 999).cast("long").alias("gap_id"), "s", "e")


def merged(iv: DataFrame, pad: int = 0) -> DataFrame:
    """(key, s, e, n): unions of intervals that overlap or touch once widened by `pad` on both sides."""
    w = Window.partitionBy("key").orderBy("s", "e")
    wide = iv.select("key", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = wide.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    numbered = starts.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("run")


def covered(iv: DataFrame) -> DataFrame:
    """(key, busy): time that intervals of a key cover, parallel ones once."""
    return merged(iv).groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("busy"))


def running_offset(iv: DataFrame) -> DataFrame:
    """Adds `offset`: the durations of all earlier intervals of the key."""
    w = Window.partitionBy("key").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    return iv.withColumn("offset", F.coalesce(F.sum(F.col("e") - F.col("s")).over(w), F.lit(0)))


def binned(iv: DataFrame, width: int, point: bool = False) -> DataFrame:
    """A row for each bin of `width` that an interval touches."""
    bins = F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width)) if not point else F.array(F.floor(F.col("s") / width))
    return iv.withColumn("bin", F.explode(bins))


def overlaps(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Pairs of an interval of a and one of b with the same key and common time: (key, a_id, b_id, a_s, a_e, b_s, b_e).

    Both sides are dealt to bins, joined by key and bin, and a pair is kept in the bin of the later start only, so that it
    appears once without a distinct. `width` should be near a usual length: it sets how many rows a long one becomes."""
    x = binned(a.select("key", F.col("id").alias("a_id"), "s", "e"), width).withColumnsRenamed({"s": "a_s", "e": "a_e"})
    y = binned(b.select("key", F.col("id").alias("b_id"), "s", "e"), width).withColumnsRenamed({"s": "b_s", "e": "b_e"})
    both = x.join(y, ["key", "bin"]).where((F.col("a_s") < F.col("b_e")) & (F.col("b_s") < F.col("a_e")))
    return both.where(F.col("bin") == F.floor(F.greatest("a_s", "b_s") / width)).drop("bin")


def overlaps_clipped(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """Overlapping pairs with the common stretch."""
    return overlaps(a, b, width).select("key", "a_id", "b_id", F.greatest("a_s", "b_s").alias("s"), F.least("a_e", "b_e").alias("e"))


def most_overlapping(a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(key, a_id, b_id, shared): for each interval of a the one of b with the most common time less a thousandth of the
    distance of their middles; of equals the one with the greatest id. Without common time that is the one whose middle is
    nearest, so every interval of a gets a partner if its key has any in b. Whole times are compared as whole numbers.

    The best partner shares time or has the nearest middle: an overlap join and two as-of joins find all that can win."""
    pairs = overlaps(a, b, width)
    shared = F.greatest(F.least("a_e", "b_e") - F.greatest("a_s", "b_s"), F.lit(0))
    away = F.abs(F.col("a_s") + F.col("a_e") - F.col("b_s") - F.col("b_e"))
    scored = pairs.select("key", "a_id", "b_id", shared.alias("shared"), (2000 * shared - away).alias("score"))
    middles = lambda side, sign: side.select("key", "id", (sign * (F.col("s") + F.col("e"))).alias("t"))
    for sign in (1, -1):
        near = asof.backward(middles(a, sign), middles(b, sign)).where("match_id is not null")
        near = near.select("key", F.col("id").alias("a_id"), F.col("match_id").alias("b_id"), (F.col("match_t") - F.col("t")).alias("score"))
        # common time, where there is some, is in the pairs above, with a greater score
        scored = scored.unionByName(near.select("key", "a_id", "b_id", F.lit(0).cast("long").alias("shared"), "score"))
    best = F.max(F.struct("score", "b_id", "shared")).alias("m")
    return scored.groupBy("key", "a_id").agg(best).select("key", "a_id", F.col("m.b_id").alias("b_id"), F.col("m.shared").alias("shared"))


def not_contained(iv: DataFrame) -> DataFrame:
    """Intervals that no other interval of the key contains; of equal ones the smallest id stays.

    An interval is contained if one before it, by start, then later end, then id, reaches its end: one window."""
    w = Window.partitionBy("key").orderBy("s", F.desc("e"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return iv.withColumn("reach", F.max("e").over(w)).where(F.col("reach").isNull() | (F.col("reach") < F.col("e"))).drop("reach")


def offset_lookup(iv: DataFrame, pad: int = 0) -> DataFrame:
    """(key, id, offset): where each interval starts when the merged ranges of its key are laid end to end.

    A range is known by its running number, which the window that merges gives every interval, so no join is needed."""
    w = Window.partitionBy("key").orderBy(*ORDER)
    wide = iv.select("key", "id", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # time up to a new range that no range covers: the hole before each new range, summed
    hole = F.when(before.isNull(), F.lit(0)).otherwise(F.greatest(F.col("s") - before, F.lit(0)))
    holes = wide.withColumn("hole", hole)
    lost = F.sum("hole").over(w.rowsBetween(Window.unboundedPreceding, 0))
    origin = F.min("s").over(Window.partitionBy("key"))
    return holes.select("key", "id", (F.col("s") - origin - lost).alias("offset"))
