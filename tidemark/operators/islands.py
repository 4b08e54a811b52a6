"""Gaps and islands: runs of equal labels, sessions by pauses, turns, first-appearance numbers, splits with lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered_runs(df: DataFrame, label: str | Column, order: list[str], name: str = "run") -> DataFrame:
    """Adds the number of the maximal run of equal labels, from 1 in each key."""
    w = Window.partitionBy("key").orderBy(*order)
    label = F.col(label) if isinstance(label, str) else label
    changed = F.when(F.lag(label).over(w).eqNullSafe(label) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def islands(df: DataFrame, label: str, at: str, order: list[str]) -> DataFrame:
    """(key, run, label, s, e, n): maximal runs with their first and last place."""
    runs = numbered_runs(df, label, order)
    return runs.groupBy("key", "run").agg(F.first(label).alias(label), F.min(at).alias("s"), F.max(at).alias("e"), F.count("*").alias("n"))


def pause_runs(df: DataFrame, pause: int, at: str = "t", order: tuple[str, ...] = ("t", "id")) -> DataFrame:
    """Adds `session`: a row at least `pause` after the one before it (the bound included) opens a new one."""
    w = Window.partitionBy("key").orderBy(*order)
    new = F.when(F.col(at) - F.lag(at).over(w) >= pause, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_new")


def pause_chunks(df: DataFrame, pause: int) -> DataFrame:
    """(key, session, s, e, n) of the sessions that pauses part."""
    return pause_runs(df, pause).groupBy("key", "session").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


def turns(df: DataFrame, label: str, at: str) -> DataFrame:
    """(key, run, label, s, e): runs, each reaching to the start of the next; the last one has no end (infinity)."""
    runs = islands(df, label, at, [at])
    following = F.lead("s").over(Window.partitionBy("key").orderBy("run"))
    return runs.select("key", "run", label, F.col("s").cast("double").alias("s"), F.coalesce(following.cast("double"), F.lit(float("inf"))).alias("e"))


def first_appearance(df: DataFrame, label: str, at: str) -> DataFrame:
    """Adds `rank`: labels of a key numbered from 1 in order of their first row."""
    first = F.min(at).over(Window.partitionBy("key", label))
    return df.withColumn("_first", first).withColumn("rank", F.dense_rank().over(Window.partitionBy("key").orderBy("_first", label)).cast("long")).drop("_first")


def parts(words: DataFrame, segment: int, cut_every: int) -> DataFrame:
    """(key, seg, part, i, w): segments of `segment` words, split at the given word offsets inside them; part ids encode
    segment and first word as 1000000 + 1000 * seg + word, an unsplit or first part keeps the segment's number."""
    seg = F.floor(F.col("i") / segment)
    placed = words.select("key", seg.alias("seg"), F.pmod(F.col("i"), F.lit(segment)).alias("o"), "i", "w")
    cut = F.floor(F.col("o") / cut_every) * cut_every
    return placed.select("key", "seg", F.when(cut == 0, F.col("seg")).otherwise(1_000_000 + 1000 * F.col("seg") + cut).alias("part"), F.col("o"), "i", "w")


def regrouped(split: DataFrame) -> DataFrame:
    """(key, part, seg, first, last, n, text): parts with their words put together again in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]), " ")
    return split.groupBy("key", "seg", "part").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), text.alias("text"))


def parts_of_lists(texts: DataFrame, segment: int, cut_every: int) -> DataFrame:
    """(key, seg, part, first, last, n, text): regrouped(parts()) of texts (key, words), inside their rows, so that no word moves.
    Null and empty words keep their places but belong to no part."""
    starts = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.pmod(F.pmod(i, F.lit(segment)), F.lit(cut_every)) == 0)

    def part(a: Column) -> Column:
        size = F.least(F.lit(cut_every), segment - F.pmod(a, F.lit(segment)))
        return F.struct(a.cast("long").alias("a"), F.slice("words", a + 1, size).alias("ws"))

    cut = texts.where(F.size("words") > 0).select("key", F.inline(F.transform(starts, part)))
    real = F.filter("ws", lambda w: w != "")
    places = F.filter(F.transform("ws", lambda w, k: F.when(w != "", k)), lambda k: k.isNotNull())
    told = cut.select("key", "a", F.floor(F.col("a") / segment).alias("seg"), real.alias("real"), F.when(F.size(real) < F.size("ws"), places).alias("places"), F.size("ws").alias("size")).where(F.size("real") > 0)
    o = F.col("a") - F.col("seg") * segment
    first, last = F.coalesce(F.array_min("places"), F.lit(0)), F.coalesce(F.array_max("places"), F.col("size") - 1)
    return told.select("key", "seg", F.when(o == 0, F.col("seg")).otherwise(1_000_000 + 1000 * F.col("seg") + o).alias("part"), (F.col("a") + first).alias("first"), (F.col("a") + last).alias("last"), F.size("real").cast("long").alias("n"), F.array_join("real", " ").alias("text"))


def lineage(split: DataFrame) -> DataFrame:
    """(key, seg, o, part, pos): where each word of a segment has gone."""
    pos = F.row_number().over(Window.partitionBy("key", "seg", "part").orderBy("o")) - 1
    return split.select("key", "seg", "o", "part", pos.cast("long").alias("pos"))


def remapped_spans(choices: DataFrame, line: DataFrame) -> DataFrame:
    """(key, choice, part, first, last): ranges of segment words (key, choice, seg, a, b) carried to parts, a range for each
    part that it reaches; last is null where it runs to the part's end.

    A range is opened into the words it covers, so the join with the lineage is by equality."""
    size = line.groupBy("key", "seg", "part").agg((F.max("pos")).alias("final"))
    each = choices.select("key", "choice", "seg", F.explode(F.sequence("a", "b")).alias("o"))
    hit = each.join(line, ["key", "seg", "o"]).groupBy("key", "choice", "seg", "part").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return hit.join(size, ["key", "seg", "part"]).select("key", "choice", "part", "first", F.when(F.col("last") < F.col("final"), F.col("last")).alias("last"))


def spans_of_lists(texts: DataFrame, segment: int, cut_every: int, a: int, b: int) -> DataFrame:
    """(key, choice, part, first, last): remapped_spans() of words a to b of every segment over lineage(parts()), of texts (key,
    words), inside their rows, so that no word moves. Null and empty words keep their places but belong to no part.

    A text without such words is told by its size alone; of any other each segment keeps the places of its real words."""
    size = F.size("words")
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((size - 1) / segment))
    real = lambda s: F.filter(F.transform(F.slice("words", (s * segment + 1).cast("int"), segment), lambda w, k: F.when(w != "", k)), lambda k: k.isNotNull())
    plain = F.transform(numbers, lambda s: F.struct(s.alias("seg"), F.lit(None).cast("array<int>").alias("real")))
    holed = F.transform(numbers, lambda s: F.struct(s.alias("seg"), real(s).alias("real")))
    segments = texts.select("key", size.alias("size"), F.inline(F.when(size > 0, F.when(F.coalesce(F.array_contains("words", ""), F.lit(True)), holed).otherwise(plain))))
    left = F.col("size") - F.col("seg") * segment

    def count(low: int, high: int) -> Column:
        """Words of a segment from place `low` to before `high`."""
        return F.when(F.col("real").isNull(), F.greatest(F.lit(0), F.least(F.lit(high), left) - low)).otherwise(F.size(F.filter("real", lambda k: (k >= low) & (k < high)))).cast("long")

    rows = []
    for o in range(0, segment, cut_every):
        end = min(o + cut_every, segment)
        low, high = max(o, a), min(end, b + 1)
        if low < high:
            part = F.col("seg") if o == 0 else 1_000_000 + 1000 * F.col("seg") + o
            rows.append(F.struct(part.alias("part"), count(o, low).alias("first"), count(low, high).alias("inside"), count(high, end).alias("after")))
    if not rows:
        return segments.select("key", F.col("seg").alias("choice"), F.col("seg").alias("part"), F.col("seg").alias("first"), F.col("seg").alias("last")).where("false")
    each = segments.select("key", F.col("seg").alias("choice"), F.inline(F.array(*rows))).where("inside > 0")
    return each.select("key", "choice", "part", "first", F.when(F.col("after") > 0, F.col("first") + F.col("inside") - 1).alias("last"))
