"""Running sums, maxima, last values and linear recurrences of a key that is dealt over many tasks.

A key's rows are cut into blocks by their place in the order. Each block is scanned by itself; of each block one row goes into
a scan over blocks, whose result every block takes over as its start. So one key with all rows uses all tasks, and only as
many rows as there are blocks meet in one.

Defined cases. A null key is a key of its own; rows whose order is null are left out by the callers below, and nulls add
nothing. Rows of equal order may change places. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold

#: Rows of a block, where a row's place is known.
BLOCK = 1 << 16


def with_carry(rows: DataFrame, totals: DataFrame, keys: list[str], carried: dict[str, Column]) -> DataFrame:
    """Rows with what a scan over the totals of the blocks before theirs gives. A block's rows find one row of totals."""
    blocks = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), *[c.alias(n) for n, c in carried.items()])
    same = rows["_block"] == blocks["_b"]
    for k in keys:
        same = same & rows[k].eqNullSafe(blocks[f"_{k}"])
    return rows.join(blocks, same).drop("_b", *[f"_{k}" for k in keys])


def running(df: DataFrame, keys: list[str], order: list[str], block: Column, sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, lasts: dict[str, str] | None = None) -> DataFrame:
    """With running sums, maxima and last values that aren't null, up to and with each row: {new name: column}. `block` must not
    fall along `order`."""
    sums, maxima, lasts = sums or {}, maxima or {}, lasts or {}
    rows = df.withColumn("_block", block)
    within = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.struct(*order)
    told = [F.sum(c).alias(f"_t_{n}") for n, c in sums.items()] + [F.max(c).alias(f"_t_{n}") for n, c in maxima.items()]
    told += [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_t_{n}") for n, c in lasts.items()]
    totals = rows.groupBy(*keys, "_block").agg(*told)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_c_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums}
    carried |= {f"_c_{n}": F.max(f"_t_{n}").over(earlier) for n in maxima}
    carried |= {f"_c_{n}": F.last(f"_t_{n}", True).over(earlier) for n in lasts}
    local = rows.select("*", *[F.sum(c).over(within).alias(f"_l_{n}") for n, c in sums.items()], *[F.max(c).over(within).alias(f"_l_{n}") for n, c in maxima.items()], *[F.last(c, True).over(within).alias(f"_l_{n}") for n, c in lasts.items()])
    out = with_carry(local, totals, keys, carried)
    both = lambda n: (F.col(f"_l_{n}"), F.col(f"_c_{n}"))
    new = {}
    for n in sums:
        here, before = both(n)
        new[n] = F.when(here.isNull() & before.isNull(), None).otherwise(F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0)))
    new |= {n: F.greatest(*both(n)) for n in maxima} | {n: F.coalesce(*both(n)) for n in lasts}
    return out.select(*df.columns, *[c.alias(n) for n, c in new.items()])


def smoothed(df: DataFrame, keys: list[str], order: list[str], block: Column, x: str, old: float) -> DataFrame:
    """With `smooth`: old times the value before plus (1 - old) times the row's own, the first as it is. Blocks are folded from
    nothing; a block's part in what follows is its end and a power of `old`, and a fold over blocks joins them."""
    rows = df.where(F.col(x).isNotNull()).withColumn("_block", block)

    def step(state, *values):
        n, y = state
        v = float(values[-1])
        y = v if n == 0 else old * y + (1 - old) * v
        return (n + 1, y), (y, n + 1)

    others = [c for c in df.columns if c not in (*keys, *order)]
    local = fold(rows.withColumn("_x", F.col(x)), [*keys, "_block"], order, [*others, "_x"], "_y double, _n long", lambda: (0, 0.0), step)
    # a block's rows count from its own first value; with v before the block, each gains old^n (v - first)
    firsts = local.where("_n = 1").select(*keys, "_block", F.col("_x").cast("double").alias("_first"))
    sizes = local.groupBy(*keys, "_block").agg(F.max("_n").alias("_n"), F.max_by("_y", "_n").alias("_y"))
    blocks = with_carry(sizes, firsts, keys, {"_first": F.col("_first")})

    def over(v, b, n, y, first):
        y = y if v is None else y + old**n * (v - first)
        return y, (v,)

    ends = fold(blocks, keys, ["_block"], ["_n", "_y", "_first"], "_before double", lambda: None, over)
    out = with_carry(local, ends, keys, {"_before": F.col("_before"), "_first": F.col("_first")})
    smooth = F.when(F.col("_before").isNull(), F.col("_y")).otherwise(F.col("_y") + F.pow(F.lit(old), F.col("_n")) * (F.col("_before") - F.col("_first")))
    return out.select(*df.columns, smooth.alias("smooth"))


#: Parts of a sample in which positions are told, so that their sums are exact.
TICKS = 1 << 20


def warped(samples: DataFrame, speed: Column, block: int = BLOCK) -> DataFrame:
    """(key, i, position, x, n_out) of samples (key, i, x) with i from 0: read at a clock that moves by `speed` at each step.

    `speed` is an expression over i and n, the number of a key's samples. The i-th value out is read at the sum of the first
    i + 1 speeds, in TICKS of a sample, between its two neighbours; reading ends before the last sample. Positions are a
    blocked running sum; the samples on both sides of one are found by equality of key and place."""
    rows = samples.where("i is not null").select("key", "i", "x")
    at = (F.col("i") / block).cast("long")
    counts = rows.groupBy("key", at.alias("_block")).agg(F.count("*").alias("_rows"))
    whole = counts.select("*", F.sum("_rows").over(Window.partitionBy("key")).alias("_n"))
    timed = with_carry(rows.withColumn("_block", at), whole, ["key"], {"n": F.col("_n")}).drop("_block")
    ticks = timed.withColumn("_step", F.round(speed * TICKS).cast("long"))
    placed = running(ticks, ["key"], ["i"], at, sums={"position": "_step"})
    kept = placed.where(F.col("position") < (F.col("n") - 1) * TICKS).select("key", "i", "position", F.floor(F.col("position") / TICKS).alias("_i"))
    # positions grow, so the kept ones are the first: their number is the largest place and one
    left = rows.select("key", F.col("i").alias("_i"), F.col("x").alias("_left"), F.lit(None).cast("double").alias("_right"))
    right = rows.select("key", (F.col("i") - 1).alias("_i"), F.lit(None).cast("double"), F.col("x"))
    pairs = left.unionAll(right).groupBy(F.col("key").alias("_key"), F.col("_i").alias("_at")).agg(F.max("_left").alias("_left"), F.max("_right").alias("_right"))
    share = (F.col("position") - F.col("_i") * TICKS) / float(TICKS)
    read = kept.join(pairs, kept["key"].eqNullSafe(pairs["_key"]) & (kept["_i"] == pairs["_at"]))
    read = read.select("key", "i", "position", (F.col("_left") * (1 - share) + F.col("_right") * share).alias("x"))
    sizes = read.groupBy("key", at.alias("_block")).agg(F.max("i").alias("_most"))
    lengths = sizes.select("*", (F.max("_most").over(Window.partitionBy("key")) + 1).alias("_out"))
    return with_carry(read.withColumn("_block", at), lengths, ["key"], {"n_out": F.col("_out")}).drop("_block")


def slowing(force: float) -> Column:
    """Speed of a clock that runs down: 1 at the start, less by up to `force` (0.45 of it, 0.8 at most) at the end."""
    return 1 - F.lit(min(0.8, 0.45 * max(0.0, force))) * F.pow(F.col("i") / F.col("n"), F.lit(1.6))


def run_down(samples: DataFrame, force: float, block: int = BLOCK) -> DataFrame:
    """(key, i, x): samples of a player whose battery runs down, getting slower and a quarter softer."""
    read = warped(samples.withColumn("x", F.col("x").cast("double")), slowing(force), block)
    return read.select("key", "i", (F.col("x") * (1 - 0.25 * F.col("i") / F.col("n_out"))).alias("x"))


def clock_read(clock: DataFrame, asked: DataFrame, block: int) -> DataFrame:
    """(key, id, t, p): where a piecewise-linear clock of knots (key, t, p) stands at the times asked (key, id, t); before its
    first knot as there, after its last as at that. The inverse of a clock that grows is the same with t and p exchanged.

    Knots and questions are one stream in order of time, in which the last knot is carried forward and, over the same stream
    turned round, the next one back; `block` is a length of time."""
    knot = clock.where("t is not null and p is not null").select("key", "t", F.lit(0).alias("_q"), F.lit(None).cast(dict(asked.dtypes)["id"]).alias("id"), F.struct("t", "p").alias("_knot"))
    ask = asked.where("t is not null").select("key", "t", F.lit(1).alias("_q"), "id", F.lit(None).cast("struct<t:long,p:long>").alias("_knot"))
    both = knot.withColumn("_knot", F.col("_knot").cast("struct<t:long,p:long>")).unionAll(ask)
    forward = running(both, ["key"], ["t", "_q", "id"], F.floor(F.col("t") / block), lasts={"_before": "_knot"})
    turned = forward.withColumns({"_t": -F.col("t"), "_turn": 1 - F.col("_q")})
    all_told = running(turned, ["key"], ["_t", "_turn", "id"], F.floor(F.col("_t") / block), lasts={"_after": "_knot"}).where("_q = 1")
    a, b = F.col("_before"), F.col("_after")
    slope = (b["p"] - a["p"]).cast("double") / F.nullif(b["t"] - a["t"], F.lit(0))
    p = F.when(a.isNull(), b["p"].cast("double")).when(b.isNull() | (a["t"] == b["t"]), a["p"].cast("double")).otherwise(a["p"] + slope * (F.col("t") - a["t"]))
    return all_told.select("key", "id", "t", p.alias("p"))
