"""Learned costs: factors from the last observations, speed ratios, the most workers that fit, remaining time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import docs


def learned_factor(observed: DataFrame, last: int = 5, margin_percent: int = 110, low: int = 500, high: int = 3000) -> DataFrame:
    """(key, factor, n): margin times the largest peak/model of the last observations, between bounds; in thousandths."""
    recent = docs.keep_newest(observed, ["key"], last).where(F.col("model") > 0)
    ratio = F.max(F.floor(F.col("peak") * 10 * margin_percent / F.col("model")))
    return recent.groupBy("key").agg(F.greatest(F.lit(low), F.least(F.lit(high), ratio)).cast("long").alias("factor"), F.count("*").alias("n"))


def speed_ratio(observed: DataFrame, low: int = 100, high: int = 10_000) -> DataFrame:
    """(key, ratio): real over planned, between a tenth and ten; in thousandths."""
    return observed.groupBy("key").agg(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(F.sum("peak") * 1000 / F.sum("model")))).cast("long").alias("ratio"))


def most_workers(needs: DataFrame, top: int, share_percent: int = 80) -> DataFrame:
    """(key, workers): the most workers from 2 to `top` whose fixed and own memory fits into a share of what is free, else 1."""
    tried = needs.select("key", "free", F.explode(F.sequence(F.lit(2), F.lit(top))).alias("w"), "fixed", "each")
    fits = (F.col("fixed") + F.col("w") * F.col("each")) * 100 <= F.col("free") * share_percent
    return tried.groupBy("key").agg(F.coalesce(F.max(F.when(fits, F.col("w"))), F.lit(1)).cast("long").alias("workers"))


def verdicts(needs: DataFrame) -> DataFrame:
    """Adds a verdict: ok up to 80 % of what is free, tight up to all of it, else insufficient."""
    need = F.col("fixed") + F.col("each")
    return needs.withColumn("verdict", F.when(need * 100 <= F.col("free") * 80, "ok").when(need <= F.col("free"), "tight").otherwise("insufficient"))


def peak_step(steps: DataFrame) -> DataFrame:
    """(key, id, peak, total): the step with the largest need, the first of equals, and the sum over all."""
    best = F.max(F.struct("peak", (-F.col("t")).alias("t"), (-F.col("id")).alias("id"))).alias("m")
    return steps.groupBy("key").agg(best, F.sum("peak").alias("total")).select("key", (-F.col("m.id")).alias("id"), F.col("m.peak").alias("peak"), "total")


def lanes_left(ops: DataFrame) -> DataFrame:
    """(key, left): operations of the main lane one after another, those alongside at the same time: the longer of both."""
    main = F.coalesce(F.sum(F.when(~F.col("alongside"), F.col("cost"))), F.lit(0))
    side = F.coalesce(F.sum(F.when(F.col("alongside"), F.col("cost"))), F.lit(0))
    return ops.groupBy("key").agg(F.greatest(main, side).alias("left"))


def estimate(steps: DataFrame, least: int = 3) -> DataFrame:
    """(key, seconds): the sum of mean durations by kind, where each kind has enough samples; else null."""
    per = steps.groupBy("key", "kind").agg(F.count("*").alias("n"), F.sum("cents").alias("total"))
    each = per.groupBy("key").agg(F.bool_and(F.col("n") >= least).alias("known"), F.sum(F.floor(F.col("total") / F.col("n"))).alias("sum"))
    return each.select("key", F.when(F.col("known"), F.col("sum")).alias("seconds"))


def shares(rows: DataFrame) -> DataFrame:
    """(key, label, total, permille): totals of labels with their share of the key's, by most first the winner is marked."""
    per = rows.groupBy("key", "label").agg(F.sum("amount").alias("total"))
    w = Window.partitionBy("key")
    best = F.row_number().over(w.orderBy(F.desc("total"), F.desc("label"))) == 1
    return per.select("key", "label", "total", F.floor(F.col("total") * 1000 / F.sum("total").over(w)).cast("long").alias("permille"), best.alias("winner"))


def render_plans(needs: DataFrame, need: Callable[[Column, Column], Column], top: int, least_clips: int = 8, share_percent: int = 80) -> DataFrame:
    """(key, workers, clips) of rows (key, free, wanted, …): the most workers, up to `top`, that leave room for parts of at least
    `least_clips` clips (or of all that are wanted), and the most clips a part that fit beside them; one of each at least.

    `need` gives the memory of (workers, clips) and grows with both, so what fits is bounded by a staircase: one walk down it,
    of at most top + wanted steps in a column expression, finds the corner that no grid of pairs has to be searched for. A
    row without free memory or a wanted number is left out; less than one wanted clip counts as one."""
    rows = needs.where("free is not null and wanted is not null").withColumn("_most", F.greatest(F.col("wanted").cast("long"), F.lit(1).cast("long")))
    state = lambda w, c, done: F.struct(w.cast("long").alias("w"), c.cast("long").alias("c"), done.alias("done"))

    def step(s: Column, _: Column) -> Column:
        more = s["c"] + 1
        fits = (more <= F.col("_most")) & (need(s["w"], more) * 100 <= F.col("free") * share_percent)
        enough = (s["w"] <= 1) | (s["c"] >= F.least(F.col("_most"), F.lit(least_clips)))
        return F.when(s["done"], s).when(fits, state(s["w"], more, F.lit(False))).when(enough, state(s["w"], s["c"], F.lit(True))).otherwise(state(s["w"] - 1, s["c"], F.lit(False)))

    walk = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("_most") + top + 1), state(F.lit(max(1, top)), F.lit(0), F.lit(False)), step)
    return rows.withColumn("_end", walk).select("key", F.col("_end.w").alias("workers"), F.greatest(F.col("_end.c"), F.lit(1).cast("long")).alias("clips"))


def with_beside(operations: DataFrame, along: tuple[tuple[str, str], ...]) -> DataFrame:
    """(key, position, op, need, total) of a key's operations in order: for each pair (side, join) the side operation runs along
    with those after it and before the one that waits for it, and its need is added to theirs. Of operations that a key has
    twice, the first place counts; a pair that isn't there in this order adds nothing."""
    whole = Window.partitionBy("key")
    out, total = operations, F.coalesce(F.col("need"), F.lit(0))
    for n, (side, join) in enumerate(along):
        first = lambda op, what: F.min(F.when(F.col("op") == op, what)).over(whole)
        out = out.withColumn(f"_{n}", F.struct(first(side, F.struct("position", "need")).alias("side"), first(join, F.col("position")).alias("join")))
        at = F.col(f"_{n}")
        inside = (F.col("position") > at["side"]["position"]) & (F.col("position") < at["join"])
        total = total + F.when(inside, F.coalesce(at["side"]["need"], F.lit(0))).otherwise(0)
    return out.select("key", "position", "op", "need", total.alias("total"))
