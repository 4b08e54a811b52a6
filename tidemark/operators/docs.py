"""Settings and documents as rows: latest state, fingerprints, differences, patches, coercions, catalogues, edits of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

from .intervals import merged


def latest(states: DataFrame, by: list[str]) -> DataFrame:
    """(…by, t, id, k): the last row of each key, of equal times the largest id."""
    last = F.max(F.struct("t", "id", "k")).alias("m")
    return states.groupBy(*by).agg(last).select(*by, "m.t", "m.id", "m.k")


def fingerprint(states: DataFrame) -> DataFrame:
    """(key, print): a hash over the settings of a key, in order of their names."""
    now = latest(states, ["key", "kind"])
    line = F.concat(F.col("kind"), F.lit("\n"), F.coalesce("k", F.lit("")), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", line.alias("l")))), lambda x: x["l"]), "")
    return now.groupBy("key").agg(F.substring(F.sha1(joined.cast("binary")), 1, 16).alias("print"))


def difference(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """(…by, old, new): settings that are new or have changed; those that only `before` has don't count."""
    joined = after.withColumnRenamed("k", "new").join(before.withColumnRenamed("k", "old"), by, "left")
    return joined.where(~F.col("old").eqNullSafe(F.col("new"))).select(*by, "old", "new")


def coerced(states: DataFrame) -> DataFrame:
    """(key, id, as_double, as_long, is_true): a text value as numbers, with defaults where it isn't one."""
    return states.select("key", "id", S.as_double(F.col("k"), -1.0).alias("as_double"), S.as_long(F.col("k")).alias("as_long"), S.truthy(F.col("k"), "string").alias("is_true"))


def patched(base: Column, patch: Column) -> Column:
    """A map with a patch laid over it, whose null values delete."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, F.map_filter(patch, lambda k, v: v.isNotNull()))


def patch_rows(base: DataFrame, patch: DataFrame, by: list[str]) -> DataFrame:
    """The same on rows (…by, k): the patch's value where it names the setting, no row where that is null."""
    joined = base.withColumnRenamed("k", "old").join(patch.withColumn("named", F.lit(True)).withColumnRenamed("k", "new"), by, "full")
    value = F.when(F.col("named"), F.col("new")).otherwise(F.col("old"))
    return joined.select(*by, value.alias("k")).where(F.col("k").isNotNull())


def used_in(states: DataFrame) -> DataFrame:
    """(kind, documents): in how many keys each kind occurs."""
    return states.select("key", "kind").distinct().groupBy("kind").agg(F.count("*").alias("documents"))


def keep_newest(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc("t"), F.desc("id"))
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def unique_names(rows: DataFrame, name: str) -> DataFrame:
    """Names told apart by number where they are equal but for case: first as it is, then 'name (2)' and so on."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy("id"))
    return rows.withColumn("unique", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))))


#: Settings that a document can have.
MOST_SETTINGS = 1000


def clamped_settings(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(key, name, value): each setting of `bounds` (name, low, high, usual) for each key, its own value or the usual one,
    inside the bounds. The bounds are a dimension: over MOST_SETTINGS of them are an error."""
    told = bounds.select("name", "low", "high", "usual").limit(MOST_SETTINGS + 1).collect()
    if len(told) > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} settings")
    kinds = dict(bounds.dtypes)
    each = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in ("name", "low", "high", "usual")]) for r in told])
    every = rows.select("key").distinct().select("key", F.explode(each).alias("b")).select("key", "b.*") if told else rows.select("key").limit(0).join(bounds.limit(0), F.lit(True))
    joined = every.join(rows.select("key", "name", "value"), ["key", "name"], "left")
    return joined.select("key", "name", F.greatest("low", F.least("high", F.coalesce("value", "usual"))).alias("value"))


def split_part(parts: DataFrame, at: DataFrame) -> DataFrame:
    """Parts (key, s, e) cut at the times (key, t) that lie inside them: an event-sourced edit of a table of parts."""
    cuts = parts.select("key", F.col("s").alias("p")).unionByName(parts.select("key", F.col("e").alias("p"))).unionByName(at.select("key", F.col("t").alias("p"))).distinct()
    following = F.lead("p").over(Window.partitionBy("key").orderBy("p"))
    pieces = cuts.select("key", F.col("p").alias("s"), following.alias("e")).where("e is not null")
    # a piece belongs to the part that starts last at or before it, if it ends there too
    marks = parts.select("key", F.col("s").alias("p"), "e").withColumnRenamed("e", "until")
    joined = pieces.join(marks, (pieces["key"] == marks["key"]) & (pieces["s"] == marks["p"]), "left").select(pieces["key"], "s", "e", "until")
    held = F.last("until", True).over(Window.partitionBy("key").orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("held", held).where(F.col("held") >= F.col("e")).select("key", "s", "e")


def joined_parts(parts: DataFrame) -> DataFrame:
    """Undoes the cuts: parts that touch become one."""
    return merged(parts).select("key", "s", "e")
