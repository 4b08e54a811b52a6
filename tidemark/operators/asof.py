"""As-of joins: each row of one side with the row of the other that is nearest in time, before, after or either way.

Both sides are put together and sorted once by key and time; the nearest row is carried along by a window. One shuffle,
no pairs. Rows are (key, id, t); ties in time are settled by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _together(left: DataFrame, right: DataFrame) -> DataFrame:
    here = F.lit(None).cast("struct<t:bigint,id:bigint>")
    a = left.select("key", "id", "t", here.alias("hit"), F.lit(1).alias("side"))
    b = right.select("key", "id", "t", F.struct("t", "id").alias("hit"), F.lit(0).alias("side"))
    return a.unionByName(b)


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, id, t, back, fore): the last right row at or before t (largest id of equals) and the first one after (smallest
    id of equals), each a struct (t, id) or null."""
    rows = _together(left, right)
    back = Window.partitionBy("key").orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    # the same order read the other way: a right row at the same time comes before the left one, so it isn't after it
    fore = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select("*", F.last("hit", True).over(back).alias("back"), F.last("hit", True).over(fore).alias("fore"))
    return filled.where("side = 1").select("key", "id", "t", "back", "fore")


def backward(left: DataFrame, right: DataFrame, within: int | None = None) -> DataFrame:
    """(key, id, t, match_id, match_t): the last right row at or before each left row; nulls where there is none."""
    rows = _together(left, right)
    back = Window.partitionBy("key").orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("back", F.last("hit", True).over(back)).where("side = 1")
    if within is not None:
        found = found.withColumn("back", F.when(F.col("t") - F.col("back.t") <= within, F.col("back")))
    return found.select("key", "id", "t", F.col("back.id").alias("match_id"), F.col("back.t").alias("match_t"))


def nearest(left: DataFrame, right: DataFrame, within: int | None = None) -> DataFrame:
    """(key, id, t, match_id, match_t): the nearest right row either way, the earlier one of equally near."""
    found = both_ways(left, right)
    take_back = F.col("fore").isNull() | (F.col("t") - F.col("back.t") <= F.col("fore.t") - F.col("t"))
    found = found.withColumn("m", F.when(F.col("back").isNotNull() & take_back, F.col("back")).otherwise(F.col("fore")))
    if within is not None:
        found = found.withColumn("m", F.when(F.abs(F.col("t") - F.col("m.t")) <= within, F.col("m")))
    return found.select("key", "id", "t", F.col("m.id").alias("match_id"), F.col("m.t").alias("match_t"))


def point_to_interval(points: DataFrame, iv: DataFrame) -> DataFrame:
    """(key, id, iv_id, distance): for each point the interval that contains it, else the nearest; of several that contain
    it or are equally near the one that reaches furthest, then the earliest started, then the smallest id.

    Intervals of a key may overlap, so the candidates are: of those started at or before the point, the one that reaches
    furthest so far; and the next to start. The first is the nearest of the started ones whatever its distance."""
    a = points.select("key", "id", "t", F.lit(1).alias("side"), F.lit(None).cast("struct<reach:bigint,less_s:bigint,less_id:bigint>").alias("far"), F.lit(None).cast("struct<s:bigint,id:bigint>").alias("next"))
    b = iv.select("key", "id", F.col("s").alias("t"), F.lit(0).alias("side"), F.struct(F.col("e").alias("reach"), (-F.col("s")).alias("less_s"), (-F.col("id")).alias("less_id")).alias("far"), F.struct("s", "id").alias("next"))
    back = Window.partitionBy("key").orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    fore = Window.partitionBy("key").orderBy(F.desc("t"), F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    found = a.unionByName(b).select("*", F.max("far").over(back).alias("best"), F.last("next", True).over(fore).alias("after")).where("side = 1")
    late = F.greatest(F.col("t") - F.col("best.reach"), F.lit(0))
    early = F.col("after.s") - F.col("t")
    use_back = F.col("best").isNotNull() & (F.col("after").isNull() | (late <= early))
    return found.select("key", "id", F.when(use_back, -F.col("best.less_id")).otherwise(F.col("after.id")).alias("iv_id"), F.when(use_back, late).otherwise(early).alias("distance"))
