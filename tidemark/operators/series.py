"""Time series: rolling statistics, onsets and spikes, energies over sliding windows, gated means, filling and interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import folds
from .islands import numbered_runs


def by_key(*order: str):
    return Window.partitionBy("key").orderBy(*order)


def edge_extended_sum(df: DataFrame, value: str, reach: int, order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """Adds `around`: the sum over 2 * reach + 1 rows, where rows beyond either end count as the end's row."""
    w = by_key(*order)
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = F.count("*").over(Window.partitionBy("key"))
    k = F.row_number().over(w)
    inner = F.sum(value).over(w.rowsBetween(-reach, reach))
    low, high = F.greatest(reach + 1 - k, F.lit(0)), F.greatest(k + reach - n, F.lit(0))
    return df.withColumn("around", inner + low * F.first(value).over(every) + high * F.last(value).over(every))


def rolling_least(df: DataFrame, value: str, reach: int, order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    return df.withColumn("least", F.min(value).over(by_key(*order).rowsBetween(-reach, reach)))


def median_of(values: Column) -> Column:
    """Median of an array, the mean of the two middle ones where even; null of an empty one."""
    s, n = F.array_sort(values), F.size(values)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2)


def rolling_median(df: DataFrame, value: str, before: int, after: int, name: str = "median", order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """Adds the median over a frame of rows; the frame bounds the array."""
    return df.withColumn(name, median_of(F.collect_list(value).over(by_key(*order).rowsBetween(before, after))))


def onsets(df: DataFrame, value: str, times: int, least: int, rest: int, trailing: int = 10) -> DataFrame:
    """(key, t, id): rows over `times` the median of the `trailing` rows before and over `least`, at least `rest` apart."""
    w = by_key("t", "id").rowsBetween(-trailing, -1)
    marked = df.withColumn("m", median_of(F.collect_list(value).over(w)))
    return folds.refractory(marked.where((F.col(value) > times * F.col("m")) & (F.col(value) > least)), rest)


def spikes(df: DataFrame, value: str, above: int, longest: int, reach: int = 5, rise: int | None = None, around: int = 4) -> DataFrame:
    """(key, t, id, strength): runs of up to `longest` rows that lie more than `above` over the rolling median of `reach`
    rows each way, told by their strongest row, the first of equals. With `rise` the run's highest value must also exceed by
    more than that what lies `around` rows before its first row and after its last one (the key's first or last row where it
    has no more)."""
    w = by_key("t", "id")
    before = F.coalesce(F.lag(value, around).over(w), F.first(value).over(w))
    after = F.coalesce(F.lead(value, around).over(w), F.last(value).over(w.rowsBetween(0, Window.unboundedFollowing)))
    marked = rolling_median(df, value, -reach, reach).withColumns({"hot": F.col(value) - F.col("median") > above, "before": before, "after": after})
    runs = numbered_runs(marked, "hot", ["t", "id"]).where("hot")
    best = F.max(F.struct((F.col(value) - F.col("median")).alias("strength"), (-F.col("t")).alias("t"), (-F.col("id")).alias("id"))).alias("b")
    place = F.struct("t", "id")
    found = runs.groupBy("key", "run").agg(best, F.count("*").alias("n"), F.max(value).alias("top"), F.min_by("before", place).alias("before"), F.max_by("after", place).alias("after")).where(F.col("n") <= longest)
    if rise is not None:
        found = found.where(F.col("top") > F.greatest("before", "after") + rise)
    return found.select("key", (-F.col("b.t")).alias("t"), (-F.col("b.id")).alias("id"), F.col("b.strength").alias("strength"))


def strongest(events: DataFrame, rest: int, n: int) -> DataFrame:
    """Of each key the n strongest rows that are `rest` apart; of equals the earliest."""
    kept = folds.strongest_apart(events, rest)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("strength"), "t", "id"))
    return kept.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def sliding_sums(df: DataFrame, value: str, sizes: tuple[int, ...]) -> DataFrame:
    """For each size the sum over that many rows up to this one, null before there are so many."""
    w = by_key("t", "id")
    k = F.row_number().over(w)
    return df.select("*", *[F.when(k >= n, F.sum(value).over(w.rowsBetween(1 - n, 0))).alias(f"sum{n}") for n in sizes])


def binned_energy(df: DataFrame, energy: str, level: Column) -> DataFrame:
    """(key, bin, n, total): counts and exact sums of energy by level bins: what gates need, of bounded size."""
    return df.select("key", level.cast("long").alias("bin"), F.col(energy).alias("_e")).groupBy("key", "bin").agg(F.count("*").alias("n"), F.sum("_e").alias("total"))


def gated_mean(bins: DataFrame, absolute: int, below: int) -> DataFrame:
    """(key, gate, n, total): energy over the bins from both gates up: the absolute one, and the level of the mean above it
    less `below` bins. A bin's level is ten times the binary logarithm of its energy."""
    loud = bins.where(F.col("bin") >= absolute)
    w = Window.partitionBy("key")
    mean = F.sum("total").over(w) / F.sum("n").over(w)
    gate = F.greatest(F.floor(10 * F.log2(mean)) - below, F.lit(absolute))
    return loud.withColumn("gate", gate).where(F.col("bin") >= F.col("gate")).groupBy("key", "gate").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def ranked_range(bins: DataFrame, low: float = 0.10, high: float = 0.95) -> DataFrame:
    """(key, lo, hi, spread): bins at ranks round(p * (n - 1)) of the binned values, and their distance."""
    w = Window.partitionBy("key").orderBy("bin")
    upto = bins.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("key")))
    at = lambda p: F.min(F.when(F.col("upto") > F.round(F.lit(p) * (F.col("all") - 1)), F.col("bin")))
    return upto.groupBy("key").agg(at(low).alias("lo"), at(high).alias("hi")).select("key", "lo", "hi", (F.col("hi") - F.col("lo")).alias("spread"))


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once: the product's and the sum's rounding errors are exact doubles and are added to the sum."""
    split = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p, a1, b1 = a * b, split(a), split(b)
    a2, b2, s = a - a1, b - b1, p + c
    lost = (((a1 * b1 - p) + a1 * b2) + a2 * b1) + a2 * b2
    return s + (((p - (s - (s - p))) + (c - (s - p))) + lost)


def quantiles(df: DataFrame, value: str, wanted: dict[str, tuple[Column, float]]) -> DataFrame:
    """(key, …, n_…): for each name the quantile of the values of rows where its condition holds, and the number of these rows,
    with and without values.

    A quantile lies between two neighbouring ranks as fused(low, 1 - share, high * share), so that it is the same double as in
    DuckDB. Equal values are counted first, so only a key's different values are ranked.
    Null values have no rank; without values the quantile is null."""
    here = F.col(value).isNotNull()
    counts = df.groupBy("key", value).agg(*[F.count_if(c).alias(f"n_{name}") for name, (c, _) in wanted.items()])
    upto, whole = Window.partitionBy("key").orderBy(value).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("key")
    ranked = counts.select("*", *[F.coalesce(F.sum(F.when(here, F.col(f"n_{n}"))).over(w), F.lit(0)).alias(f"_{k}_{n}") for n in wanted for k, w in (("u", upto), ("n", whole))])
    told, out = [], []
    for n, (_, p) in wanted.items():
        rank = p * (F.col(f"_n_{n}") - 1).cast("double")
        at = lambda k, n=n: F.min(F.when((F.col(f"_n_{n}") > 0) & (F.col(f"_u_{n}") > k), F.col(value)))
        told += [at(F.floor(rank)).alias(f"_low_{n}"), at(F.ceil(rank)).alias(f"_high_{n}"), F.sum(f"n_{n}").alias(f"n_{n}"), F.first(rank).alias(f"_at_{n}")]
        place = F.col(f"_at_{n}")
        share, low, high = place - F.floor(place), F.col(f"_low_{n}").cast("double"), F.col(f"_high_{n}").cast("double")
        out += [F.when(share == 0, low).otherwise(fused(low, 1 - share, high * share)).alias(n), F.col(f"n_{n}")]
    return ranked.groupBy("key").agg(*told).select("key", *out)


def peak_shape(df: DataFrame, value: str, width: int, top: int = 100) -> DataFrame:
    """(key, bucket, peak): the largest absolute value of each bucket of time, scaled so that the key's largest is `top`."""
    peaks = df.groupBy("key", F.floor(F.col("t") / width).alias("bucket")).agg(F.max(F.abs(value)).alias("p"))
    return peaks.select("key", "bucket", F.floor(F.col("p") * top / F.max("p").over(Window.partitionBy("key"))).cast("long").alias("peak"))


def grid_floor(t: Column, step: int) -> Column:
    """The last multiple of `step` at or before a whole number, exact for either sign."""
    return t - F.pmod(t, F.lit(step))


def around_grid(df: DataFrame, value: str, step: int) -> DataFrame:
    """(key, g, back, fore): for each multiple g of `step` from a key's first to its last time the last row at or before it and
    the first after it, as structs (t, v); of equal times the greatest id before, the least after.

    Only the rows are sorted, once: each is opened into the grid times from its own to the next row's. Rows without a time are
    left out."""
    w = by_key("t", "id")
    here = F.struct("t", F.col(value).alias("v"))
    rows = df.where("t is not null").select("key", "id", F.col("t").cast("long").alias("t"), value)
    found = rows.select("key", "t", here.alias("back"), F.lead(here).over(w).alias("fore"))
    first, last = -grid_floor(-F.col("t"), step), F.coalesce(grid_floor(F.col("fore.t") - 1, step), grid_floor(F.col("t"), step))
    return found.select("key", "back", "fore", first.alias("a"), last.alias("b")).where("a <= b").select("key", F.explode(F.sequence("a", "b", F.lit(step).cast("long"))).alias("g"), "back", "fore")


def interpolated(df: DataFrame, value: str, step: int, hole: int) -> DataFrame:
    """(key, g, v): linear interpolation on the grid, not inside holes longer than `hole`."""
    f = around_grid(df, value, step)
    exact = F.col("fore").isNull() | (F.col("back.t") == F.col("g"))
    share = (F.col("g") - F.col("back.t")) / (F.col("fore.t") - F.col("back.t"))
    v = F.when(exact, F.col("back.v").cast("double")).otherwise(F.col("back.v") + share * (F.col("fore.v") - F.col("back.v")))
    return f.where(exact | (F.col("fore.t") - F.col("back.t") <= hole)).select("key", "g", v.alias("v"))


def nearest_filled(df: DataFrame, value: str, step: int) -> DataFrame:
    """(key, g, v): the value of the nearest row, the earlier one of equally near."""
    f = around_grid(df, value, step)
    use_back = F.col("fore").isNull() | (F.col("g") - F.col("back.t") <= F.col("fore.t") - F.col("g"))
    return f.select("key", "g", F.when(use_back, F.col("back.v")).otherwise(F.col("fore.v")).alias("v"))


def running_most(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("most", F.max(value).over(by_key("t", "id").rowsBetween(Window.unboundedPreceding, 0)))
