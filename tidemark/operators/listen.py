"""Which words of a transcript want a second listening: classes by two dictionaries, suspects, foreign segments, inventions.

Each different word is looked up once, by joins with the dictionaries, however often it is said.

Defined cases. A null word is an empty one, which is known; a null confidence is certain; words of dictionaries that stand
twice count with their greatest share. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.functions import scalars as S

#: Times as frequent in the other language that make a word foreign; confidence below which it is in doubt.
FOREIGN_RATIO, DOUBT = 20.0, 0.5
#: Most frequent words that go to every task.
MOST_WORDS = 1 << 17


def dictionary_classes(own: DataFrame, other: DataFrame) -> DataFrame:
    """(form, kind): known or foreign, for the words of two dictionaries (word, share)."""
    a = own.groupBy("word").agg(F.max("share").alias("a"))
    b = other.groupBy("word").agg(F.max("share").alias("b"))
    both = a.join(b, "word", "full").select(F.col("word").alias("form"), F.coalesce("a", F.lit(0.0)).alias("a"), F.coalesce("b", F.lit(0.0)).alias("b")).where("a > 0 or b > 0")
    return both.select("form", F.when(F.col("b") >= FOREIGN_RATIO * F.col("a"), "foreign").otherwise("known").alias("kind"))


def bare(w: Column) -> Column:
    return F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def cleaned(w: Column) -> Column:
    """Lower case, straight apostrophes, ligatures opened."""
    out = F.lower(w)
    for a, b in (("’", "'"), ("‘", "'"), ("œ", "oe"), ("æ", "ae")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def word_kinds(words: DataFrame, own: DataFrame, other: DataFrame, lang: str) -> DataFrame:
    """(w, kind) of each different word (w): known, foreign, unknown, or name (unknown with a capital).

    A word that neither dictionary (word, share) has is looked up by its parts: without an elision (French), cut at hyphens
    and apostrophes, of an apostrophe alone the part before it; the worst part counts. Words with a digit are known."""
    w = words.select(F.coalesce("w", F.lit("")).alias("w")).distinct().withColumn("trimmed", bare(F.col("w"))).withColumn("clean", cleaned(F.col("trimmed")))
    rest = F.regexp_replace("clean", "^(" + "|".join(lexicon.ELISIONS) + ")(?=.)", "") if lang == "fr" else F.col("clean")
    parts = F.array_remove(F.split(rest, "[-']"), "")
    parts = F.when(rest.contains("'") & ~rest.contains("-"), F.slice(parts, 1, 1)).otherwise(parts)
    cut = w.withColumn("parts", parts).withColumn("parts", F.when((F.size("parts") == 1) & (F.get("parts", 0) == F.col("clean")), F.array().cast("array<string>")).otherwise(F.col("parts")))
    asked = cut.select("w", F.posexplode(F.concat(F.array("clean"), "parts")).alias("part", "form"))
    spoken = F.col("form").isin(*lexicon.SPOKEN.get(lang, ())) | S.is_filler(F.col("form"))
    kind = F.when(spoken, "known").otherwise(F.coalesce("kind", F.lit("unknown")))
    found = asked.join(dictionary_classes(own, other), "form", "left").select("w", "part", kind.alias("kind"))
    told = found.groupBy("w").agg(F.max(F.when(F.col("part") == 0, F.col("kind"))).alias("whole"), *[F.count_if((F.col("part") > 0) & (F.col("kind") == k)).alias(k) for k in ("known", "foreign", "unknown")])
    by_parts = F.when((F.col("unknown") > 0) | (F.col("known") + F.col("foreign") == 0), "unknown").when(F.col("foreign") > 0, "foreign").otherwise("known")
    got = F.when(F.col("whole") != "unknown", F.col("whole")).otherwise(by_parts)
    plain = (F.col("trimmed") == "") | F.col("trimmed").rlike("[0-9]")
    out = told.join(w, "w").withColumn("kind", F.when(plain, "known").otherwise(got))
    return out.select("w", F.when((F.col("kind") == "unknown") & F.col("trimmed").rlike(r"^\p{Lu}"), "name").otherwise(F.col("kind")).alias("kind"))


def key_of(w: Column) -> Column:
    """Letters and digits alone of the cleaned word; okay is ok."""
    k = F.regexp_replace(cleaned(w), r"[^\p{L}\p{N}]", "")
    return F.when(k == "okay", "ok").otherwise(k)


def frequent(counts: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(w): the most frequent words of counts (w, n)."""
    return counts.where("w is not null").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).select("w")


def with_kinds(words: DataFrame, told: DataFrame, often: DataFrame | None) -> DataFrame:
    """Words (…, w) with what is told of each different word (w, …), nulls where nothing is.

    The words of `often`, a bounded table, meet what is told of them where they stand; only the others are shuffled. Without
    it all are."""
    if often is None:
        return words.join(told, "w", "left")
    known = F.broadcast(often.join(told, "w"))
    near = words.join(known, "w")
    rest = words.join(F.broadcast(known.select("w")), "w", "left_anti").join(told.hint("shuffle_hash"), "w", "left")
    return near.unionByName(rest)


def suspects(words: DataFrame, kinds: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """(key, i, w, reason): words (key, i, w, p) in doubt by their confidence or their class; hesitations and noises aren't. `often`
    as in with_kinds()."""
    told = with_kinds(words.withColumn("w", F.coalesce("w", F.lit(""))), kinds, often)
    key = key_of(F.col("w"))
    noise = S.is_filler(key) | key.isin(*lexicon.NOISES) | F.col("w").rlike(r"^[*\[(]")
    odd = F.coalesce(F.col("kind").isin("foreign", "unknown"), F.lit(False))
    reason = F.when(F.col("kind") == "foreign", "other language").when(F.col("kind") == "unknown", "unknown").otherwise("confidence")
    # noise is asked last: most words are in no doubt
    return told.where(((F.coalesce("p", F.lit(1.0)) < DOUBT) | odd) & ~noise).select("key", "i", "w", reason.alias("reason"))


def mostly_foreign(words: DataFrame, kinds: DataFrame, often: DataFrame | None = None) -> DataFrame:
    """(key, segment): segments of words (key, segment, w) of which half or more, besides hesitations, are foreign. `kinds`
    tells each different word; which are hesitations is found out there, once for each. `often` as in with_kinds()."""
    hesitation = lambda c: S.is_filler(key_of(c))
    told = with_kinds(words.withColumn("w", F.coalesce("w", F.lit(""))), kinds.select("w", "kind", hesitation(F.col("w")).alias("_h")), often)
    real = told.where(~F.coalesce("_h", hesitation(F.col("w"))))
    per = real.groupBy("key", "segment").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "foreign").alias("foreign"))
    return per.where("2 * foreign >= n").select("key", "segment")


def invented(theirs: Column, n: Column) -> Column:
    """Whether a second version of n words looks made up: over 2n + 3 words, or one word three times and more."""
    keys = F.transform(F.coalesce(theirs, F.array().cast("array<string>")), lambda w: key_of(F.coalesce(w, F.lit(""))))
    often = F.exists(keys, lambda k: F.size(F.filter(keys, lambda x: x == k)) >= 3)
    return (F.size(keys) > 2 * n + 3) | often
