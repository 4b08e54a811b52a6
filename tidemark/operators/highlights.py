"""Captions and the highlights that mark their words: an inverted index over bins of time and words.

Defined cases. Rows without a time or words meet nothing; a highlight that ends before it starts marks nothing. Of several
highlights the one with the smallest id marks a word. Equal words of a caption are all marked. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bins(first, last, width: int):
    return F.explode(F.sequence(F.floor(first / width), F.floor(last / width)))


def marked_words(captions: DataFrame, highlights: DataFrame, width: int, early: int = 0) -> DataFrame:
    """(key, caption, place, highlight): the words (by place, from 0) of captions (key, id, s, words) that a highlight (key, id, s,
    e, words) marks: the caption starts in [s - early, e) and both have the word. Words are compared as they are.

    A highlight is posted once for each of its words in each bin of `width` that it touches, a caption's word once, in the bin
    of its start; postings meet by (key, bin, word), so no caption meets a highlight with which it shares none."""
    h = highlights.where("s is not null and e is not null and s < e")
    posted = h.select("key", F.col("id").alias("highlight"), "s", "e", F.array_distinct("words").alias("words"), bins(F.col("s") - early, F.col("e") - 1, width).alias("bin"))
    posted = posted.select("key", "highlight", "s", "e", "bin", F.explode("words").alias("word")).where("word <> ''")
    c = captions.where("s is not null").select("key", F.col("id").alias("caption"), F.col("s").alias("at"), F.floor(F.col("s") / width).alias("bin"), F.posexplode("words").alias("place", "word"))
    met = c.where("word <> ''").join(posted, ["key", "bin", "word"]).where((F.col("at") >= F.col("s") - early) & (F.col("at") < F.col("e")))
    return met.groupBy("key", "caption", "place").agg(F.min("highlight").alias("highlight"))


def shared_words(captions: DataFrame, highlights: DataFrame, width: int, early: int = 0) -> DataFrame:
    """(key, caption, highlight, n): how many of a caption's words each highlight has that is there when it starts."""
    h = highlights.where("s is not null and e is not null and s < e").select("key", F.col("id").alias("highlight"), "s", "e", F.explode(F.array_distinct("words")).alias("word"))
    posted = h.where("word <> ''").select("*", bins(F.col("s") - early, F.col("e") - 1, width).alias("bin"))
    c = captions.where("s is not null").select("key", F.col("id").alias("caption"), F.col("s").alias("at"), F.floor(F.col("s") / width).alias("bin"), F.explode(F.array_distinct("words")).alias("word"))
    met = c.join(posted, ["key", "bin", "word"]).where((F.col("at") >= F.col("s") - early) & (F.col("at") < F.col("e")))
    return met.groupBy("key", "caption", "highlight").agg(F.count("*").alias("n"))
