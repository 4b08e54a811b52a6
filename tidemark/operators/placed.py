"""Where things come to stand: words in their segment, frames of a video, captions in their clip, cut instants at words; shapes
and scores against a whole recording; digests.

Defined cases. Rows without a time or a key value that a rule needs are left out where it says so, else nulls stay null. Of
equal places the smaller id comes first. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

from . import asof


def placed_in_segment(words: DataFrame) -> DataFrame:
    """(key, segment, i, start, end) of words (key, segment, i, w, a, b, s, e) in milliseconds, within their segment [s, e].

    Words that a model put before the segment's start are piled up there: each of them, and the one after them, begins a least
    word length after the word before; the others keep their time but never begin before the word before. A word ends where
    the next one begins, the last at its own end, but lasts 300 ms if the segment does. Words without a time are left out."""
    w = Window.partitionBy("key", "segment").orderBy("i")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    timed = words.where("a is not null").withColumn("_least", S.least_length_ms(F.coalesce("w", F.lit(""))).cast("long"))
    # piled: all words before this one lie before the start
    piled = F.coalesce(F.min(F.when(F.col("a") < F.col("s"), 1).otherwise(0)).over(earlier), F.lit(1)) == 1
    told = timed.withColumn("_piled", piled).withColumn("_pile", F.col("s") + F.coalesce(F.sum("_least").over(earlier), F.lit(0)))
    # a start is cut at the end before the next one counts on from it, so a pile ends there too
    own = F.when(F.col("_piled"), F.greatest("a", F.least("_pile", F.col("e") + F.col("_least")))).otherwise(F.col("a"))
    told = told.withColumn("start", F.least("e", F.max(own).over(upto)))
    following = F.lead("start").over(w)
    last = F.least("e", F.greatest(F.coalesce("b", "start"), F.col("start") + 300))
    return told.select("key", "segment", "i", "start", F.coalesce(following, last).alias("end"))


def waveform(blocks: DataFrame) -> DataFrame:
    """(key, n, height) of peaks (key, n, peak): from 0 to 100 by the power 0.6 of the share in the key's largest."""
    top = blocks.groupBy(F.col("key").alias("_key")).agg(F.greatest(F.max("peak").cast("double"), F.lit(0.0)).alias("_top"))
    share = F.col("peak") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    return blocks.join(top, F.col("key").eqNullSafe(F.col("_key"))).select("key", "n", F.rint(100 * F.pow(share, F.lit(0.6))).cast("long").alias("height"))


#: Regular frames of a video, and most frames in all.
REGULAR, MOST_FRAMES = 18, 36


def frame_times(duration: Column, cuts: Column, most: int = MOST_FRAMES) -> Column:
    """Times of the frames to look at: regular ones and one just after each cut; too many are thinned to every second one, cuts
    first. Seconds, rounded to hundredths."""
    duration, cuts = F.coalesce(duration, F.lit(0.0)), F.coalesce(cuts, F.array().cast("array<double>"))
    regular = F.when(duration > 0, F.transform(F.sequence(F.lit(0), F.lit(REGULAR - 1)), lambda i: duration * (i + 0.5) / REGULAR)).otherwise(F.array(F.lit(0.0)))
    after = F.transform(cuts, lambda c: F.least(duration - 0.05, c + 0.15))
    rounded = lambda a: F.transform(a, lambda t: F.bround(t, 2))
    ordered = lambda a: F.array_sort(F.array_distinct(a))
    times = ordered(rounded(F.filter(F.concat(regular, after), lambda t: (t >= 0) & (t < F.greatest(duration, F.lit(0.1))))))
    thinned = F.slice(ordered(F.concat(F.slice(rounded(after), 1, most // 2), F.filter(times, lambda t, i: i % 2 == 0))), 1, most)
    return F.when(F.size(times) > most, thinned).otherwise(times)


def nearest_word(cuts: DataFrame, words: DataFrame) -> DataFrame:
    """(key, id, t, word): for each cut instant (key, id, t) the word (key, i, a) that begins nearest, never the key's first, the
    earlier of equals."""
    first = Window.partitionBy("key").orderBy("i")
    later = words.where("a is not null").withColumn("_r", F.row_number().over(first)).where("_r > 1").select("key", F.col("i").alias("id"), F.col("a").alias("t"))
    return asof.nearest(cuts, later).select("key", "id", "t", F.col("match_id").alias("word"))


def in_clips(captions: DataFrame, clips: DataFrame, width: int) -> DataFrame:
    """(key, id, s, e, clip): captions (key, id, s, e) cut at the end of the clip (key, id, s, e) in which they begin, of several
    the first; a caption in none stays as it is. Clips are posted to the bins of `width` that they touch."""
    c = clips.where("s is not null and e is not null and s < e")
    posted = c.select("key", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor((F.col("e") - 1) / width))).alias("_bin"), F.struct("s", "id", "e").alias("_clip"))
    asked = captions.withColumn("_bin", F.floor(F.col("s") / width))
    met = asked.select("key", "id", F.col("s").alias("_s"), "_bin").join(posted, ["key", "_bin"]).where((F.col("_clip.s") <= F.col("_s")) & (F.col("_s") < F.col("_clip.e")))
    first = met.groupBy(F.col("key").alias("_key"), F.col("id").alias("_id")).agg(F.min("_clip").alias("_clip"))
    out = captions.join(first, (F.col("key") == F.col("_key")) & (F.col("id") == F.col("_id")), "left")
    return out.select("key", "id", "s", F.least("e", F.coalesce(F.col("_clip.e"), F.col("e"))).alias("e"), F.col("_clip.id").alias("clip"))


def scored(chunks: DataFrame, frames: DataFrame, below: float = 40.0) -> DataFrame:
    """(key, id, k, mean, deviation) of chunks' means and deviations (the same columns) by each coefficient's spread over the
    recording's loud frames (key, k, energy, x): those less than `below` decibels under the loudest."""
    loudest = Window.partitionBy("key", "k")
    loud = frames.withColumn("_top", F.max("energy").over(loudest)).where(F.col("energy") > F.col("_top") - below)
    spread = loud.groupBy("key", "k").agg(F.avg("x").alias("_mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-6)).alias("_sd"))
    return chunks.join(spread, ["key", "k"]).select("key", "id", "k", ((F.col("mean") - F.col("_mean")) / F.col("_sd")).alias("mean"), (F.col("deviation") / F.col("_sd")).alias("deviation"))


def digest(data: Column) -> Column:
    """Eight bytes of SHA-1 as text."""
    return F.substring(F.sha1(data.cast("binary")), 1, 16)


def content_id(data: Column) -> Column:
    """Eight bytes of SHA-256 as text."""
    return F.substring(F.sha2(data.cast("binary"), 256), 1, 16)


def part_key(common: Column, page: Column) -> Column:
    """The key of a part that is kept: what all parts of a run share, and the part's own page."""
    return digest(F.concat(common.cast("binary"), F.coalesce(page, F.lit("")).cast("binary")))


def floor_divided(n: Column, d: Column, by_n: Column, by_d: Column) -> Column:
    """n/d // by_n/by_d as a whole number, towards minus infinity; null for a zero."""
    return whole_floor(n * by_d, F.nullif(d * by_n, F.lit(0)))


def whole_floor(a: Column, b: Column) -> Column:
    """a // b without going through a double."""
    sign = F.when(b < 0, -1).otherwise(1)
    a, b = a * sign, b * sign
    return ((a - F.pmod(a, b)).cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("long")


def rounded_fraction(n: Column, d: Column) -> Column:
    """n/d (d > 0) to the nearest whole number, halves to the even one; null for a zero d."""
    d = F.nullif(d, F.lit(0))
    low = whole_floor(n, d)
    twice = 2 * (n - low * d)
    return F.when((twice < d) | ((twice == d) & (low % 2 == 0)), low).otherwise(low + 1)
