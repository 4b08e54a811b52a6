"""Words: classes by frequency and language, content and filler words, containment, captions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import lexicon
from tidemark.functions import scalars as S

def with_forms(words: DataFrame) -> DataFrame:
    return words.withColumn("form", S.word_form("w"))


def content_words(words: DataFrame) -> DataFrame:
    return with_forms(words).where(S.is_content(F.col("form")))


def filler_counts(words: DataFrame) -> DataFrame:
    return with_forms(words).where(S.is_filler(F.col("form"))).groupBy("lang", "form").agg(F.count("*").alias("n"))


def foreign_texts(texts: DataFrame) -> DataFrame:
    """(key, lang, own, other, foreign) of texts (key, lang, text): function words of the own language and most of any other;
    foreign where another has two or more and more than the own, or where a letter isn't Latin.

    A text is looked at as a whole, so no word leaves its row. A null text is empty; a language without a list has none."""
    plain = F.regexp_replace(F.lower(F.replace("text", F.lit("’"), F.lit("'"))), r"[^\p{L}\p{N}'_\s]", "")
    per = texts.select("key", "lang", "text", F.split(plain, r"\s+").alias("forms"))
    among = lambda ws: F.coalesce(F.size(F.filter("forms", lambda w: w.isin(*ws))), F.lit(0)).cast("long")
    counts = {lang: among(ws) for lang, ws in lexicon.FUNCTION_WORDS.items()}
    counted = per.select("key", "lang", F.coalesce(F.col("text").rlike(r"[\p{L}&&[^A-Za-zÀ-ɏ]]"), F.lit(False)).alias("script"), *[n.alias(f"n_{lang}") for lang, n in counts.items()])
    own = F.coalesce(*[F.when(F.col("lang") == lang, F.col(f"n_{lang}")) for lang in counts], F.lit(0).cast("long"))
    other = F.greatest(*[F.when(F.coalesce(F.col("lang") == lang, F.lit(False)), F.lit(0).cast("long")).otherwise(F.col(f"n_{lang}")) for lang in counts])
    return counted.select("key", "lang", own.alias("own"), other.alias("other"), "script").select("key", "lang", "own", "other", (F.col("script") | (F.col("other") >= 2) & (F.col("other") > F.col("own"))).alias("foreign"))


def frequency_classes(words: DataFrame, own: str, other: str, ratio: int = 20) -> DataFrame:
    """(form, n_own, n_other, kind): how a word stands in two languages: known, foreign if it is `ratio` times as frequent in
    the other, unknown if in neither. Shares are compared by cross products of whole numbers."""
    per = with_forms(words).where(F.col("form") != "").groupBy("form").agg(F.count_if(F.col("lang") == own).alias("n_own"), F.count_if(F.col("lang") == other).alias("n_other"))
    totals = with_forms(words).where(F.col("form") != "").agg(F.count_if(F.col("lang") == own).alias("all_own"), F.count_if(F.col("lang") == other).alias("all_other"))
    j = per.crossJoin(F.broadcast(totals))  # one row
    foreign = (F.col("n_other") > 0) & (F.col("n_other") * F.col("all_own") >= ratio * F.col("n_own") * F.col("all_other"))
    kind = F.when((F.col("n_own") == 0) & (F.col("n_other") == 0), "unknown").when(foreign, "foreign").otherwise("known")
    return j.select("form", "n_own", "n_other", kind.alias("kind"))


def sentences(words: DataFrame) -> DataFrame:
    """Adds `sentence`, numbered from 0: a word after one that ends a sentence opens a new one."""
    w = Window.partitionBy("key").orderBy("i")
    ended = F.coalesce(F.lag(S.ends_sentence("w")).over(w), F.lit(False))
    return words.withColumn("sentence", F.sum(ended.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def missing_content(words: DataFrame) -> DataFrame:
    """(key, sentence, n_content, missing): content words of a sentence that the next one lacks."""
    content = F.array_sort(F.collect_set(F.when(S.is_content(F.col("form")), F.col("form"))))
    per = with_forms(sentences(words)).groupBy("key", "sentence").agg(content.alias("c"))
    following = F.lead("c").over(Window.partitionBy("key").orderBy("sentence"))
    return per.withColumn("d", following).where("d is not null").select("key", "sentence", F.size("c").cast("long").alias("n_content"), F.size(F.array_except("c", "d")).cast("long").alias("missing"))


def balanced_split(words: Column) -> Column:
    """After how many words a line breaks so that both halves are nearest in length, the earliest of equals; 0 for one."""
    n = F.size(words)
    cost = lambda k: F.abs(F.length(F.array_join(F.slice(words, 1, k), " ")) - F.length(F.array_join(F.slice(words, k + 1, n - k), " ")))
    best = F.array_min(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.struct(cost(k).alias("d"), k.alias("k"))))["k"]
    return F.when(n < 2, F.lit(0)).otherwise(best)


def best_split(lengths: list[int]) -> int:
    """After how many words of these lengths a line breaks so that both halves are nearest in length, the earliest of equals;
    0 for one word."""
    whole, top, best = sum(lengths) + len(lengths) - 1, -1, (0, 0)
    for k, n in enumerate(lengths[:-1], 1):
        top += n + 1
        if k == 1 or abs(2 * top + 1 - whole) < best[0]:
            best = (abs(2 * top + 1 - whole), k)
    return best[1]


def splits(lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """best_split() of the groups of words of these lengths that begin at the places `at`, the first of which is 0."""
    n = np.diff(np.append(at, len(lengths)))
    last = at + n - 1
    # length of a group up to each of its words, and of the whole one
    run = np.cumsum(lengths + 1)
    before = np.repeat(run[at] - lengths[at] - 1, n)
    top, k = run - before - 1, np.arange(len(lengths)) - np.repeat(at, n) + 1
    away = np.abs(2 * top + 1 - np.repeat(top[last], n))
    away[last] = 1 << 40
    least = np.repeat(np.minimum.reduceat(away, at), n)
    split = np.minimum.reduceat(np.where(away == least, k, len(lengths) + 1), at)
    split[n < 2] = 0
    return split


CAPTION_ROWS = "key long, caption long, first long, last long, n long, split long, following long, most long"


def ends(w: str) -> bool:
    w = w.rstrip(" ")
    return w.endswith((".", "!", "?")) and not w.endswith("..")


def caption_rows(texts: DataFrame, segment: int) -> DataFrame:
    """(key, caption, first, last, n, split, following, most): captions as caption_breaks() parts them, of texts (key, words),
    inside their rows: places of the first and last word, words before the line breaks as in balanced_split(), place of the next
    caption's first word and of the text's last. Null and empty words keep their places but belong to no caption."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().fill_null("")
            lengths = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
            kept = lengths > 0
            row = np.repeat(np.arange(len(sizes)), sizes)[kept]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
            lengths, names = lengths[kept], CAPTION_ROWS.replace(" long", "").split(", ")
            if not len(row):
                continue
            told = flat.dictionary_encode()
            ended = np.array([ends(w) for w in told.dictionary.to_pylist()], bool)[told.indices.to_numpy()][kept]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | ended[:-1] | (place[1:] % segment == 0)
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(row)))
            of, last = row[at], at + n - 1
            split = splits(lengths, at)
            number = np.arange(len(at)) - np.searchsorted(of, of) + 1
            more = np.append(of[1:] == of[:-1], False)
            following = pa.array(np.append(place[at[1:]], 0), pa.int64(), mask=~more)
            most = place[last[np.searchsorted(of, of, "right") - 1]]
            columns = [pa.array(c, pa.int64()) for c in (number, place[at], place[last], n, split)]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)).cast(pa.int64()), *columns, following, pa.array(most, pa.int64())], names)

    return texts.select("key", "words").mapInArrow(run, CAPTION_ROWS)


def caption_breaks(words: DataFrame, segment: int) -> DataFrame:
    """Adds `caption`: a new one at a segment's start and after a sentence end: the breaks that don't depend on length."""
    w = Window.partitionBy("key").orderBy("i")
    new = F.coalesce(F.lag(S.ends_sentence("w")).over(w), F.lit(True)) | (F.pmod("i", F.lit(segment)) == 0)
    return words.withColumn("caption", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
