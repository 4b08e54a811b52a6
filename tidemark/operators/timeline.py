"""Timeline compilation: captions, cues and subtitle text, clips on the output clock, expansions of repeated effects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import scalars as S

from . import text


#: Words after which a caption ends, and after which it ends if it is long enough.
STOP, COMMA = 1, 2
CAPTIONS = "key long, caption long, n long, start long, end long, split long, text string"


def captions(spoken: DataFrame, most_words: int = 6, most_letters: int = 26, pause: int = 350, clock: tuple[int, int] | None = None) -> DataFrame:
    """(key, caption, n, start, end, split, text): words in captions, numbered from 0; the first line has `split` words.

    spoken: a row for each text: key, words, and lists of their start and end (milliseconds) and moment. A caption ends after
    a sentence, once it has so many words or more letters than that, and after a comma once it has three words; a new one
    starts with a moment and after more than `pause` of silence. The word that brings a caption over its letters stays in
    it. Lines break where they are nearest in length, at the earliest of equals. A text's words are read inside its row.

    With `clock` the words stand on a regular clock: each takes so many milliseconds and a moment so many words, and only key
    and words are read.

    Where a caption that starts at a word would end is told for all words of a batch at once; then the starts are followed
    from the breaks that are certain, all texts together.

    Null or empty words are left out; null lists are empty, and lists shorter than the words go on with nulls; null times count as 0 and null moments as one moment."""

    def followed(row: np.ndarray, kinds: np.ndarray, lengths: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Places of the words that start a caption; `apart` tells the words, but the first, before which one must end."""
        n = len(row)
        begins = np.ones(n, bool)
        begins[1:] = (row[1:] != row[:-1]) | (kinds[:-1] == STOP) | apart
        here, total, comma = np.arange(n), np.cumsum(lengths), np.flatnonzero(kinds == COMMA)
        limits = (
            np.append(np.flatnonzero(begins), n)[np.cumsum(begins)] - 1,
            here + max(most_words, 1) - 1,
            np.maximum(here, np.searchsorted(total, total - lengths + most_letters, "right")),
            np.append(comma, n)[np.searchsorted(comma, here + 2)],
        )
        following, some = np.minimum.reduce(limits) + 1, np.flatnonzero(begins)
        while len(some):
            some = following[some]
            some = some[some < n]
            some = some[~begins[some]]
            begins[some] = True
        return np.flatnonzero(begins)

    def kind(w: str) -> int:
        last = w.rstrip()[-1:]
        return STOP if last in (".", "!", "?") and last else COMMA if last == "," else 0

    def beside(lists: pa.Array, row: np.ndarray, place: np.ndarray) -> pa.Array:
        """What a column of lists has at these places of these rows, null where a list is shorter."""
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = (np.cumsum(sizes) - sizes)[row] + place
        return lists.flatten().take(pa.array(at, pa.int64(), mask=place >= sizes[row]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().fill_null("")
            kept = pc.utf8_length(flat).to_numpy(zero_copy_only=False) > 0
            row = np.repeat(np.arange(len(sizes)), sizes)[kept]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
            if not len(row):
                continue
            words = flat if kept.all() else flat.filter(pa.array(kept))
            lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            told = words.dictionary_encode()
            kinds = np.array([kind(w) for w in told.dictionary.to_pylist()], np.int8)[told.indices.to_numpy()]
            if clock is not None:
                start, end, moment = place * clock[0], (place + 1) * clock[0], place // clock[1]
            else:
                start, end = (beside(batch.column(c), row, place).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("start", "end"))
                moment = beside(batch.column("moment"), row, place).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            at = followed(row, kinds, lengths, (start[1:] - end[:-1] > pause) | (moment[1:] != moment[:-1]))
            stop = np.append(at[1:], len(row))
            of = row[at]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), words), " ")
            number = np.arange(len(at)) - np.searchsorted(of, of)
            columns = [pa.array(c, pa.int64()) for c in (number, stop - at, start[at], end[stop - 1], text.splits(lengths, at))]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of)).cast(pa.int64()), *columns, lines], ["key", "caption", "n", "start", "end", "split", "text"])

    return spoken.select("key", "words", *(() if clock else ("start", "end", "moment"))).mapInArrow(run, CAPTIONS)


def cues(caps: DataFrame, tail: int = 1200, least: int = 500, apart: int = 40) -> DataFrame:
    """(key, n, start, end, text): captions without empty ones; each lasts at least `least` and at most `tail` after its
    words' end, but ends `apart` before the next one starts where it would run into it."""
    w = Window.partitionBy("key").orderBy("start", "caption")
    full = caps.where(F.trim("text") != "")
    following = F.lead("start").over(w)
    wanted = F.greatest(F.least(F.coalesce(following, F.col("end") + tail), F.col("end") + tail), F.col("start") + least)
    end = F.when(following.isNotNull() & (wanted > following), F.greatest(following - apart, F.col("start") + apart)).otherwise(wanted)
    return full.select("key", F.row_number().over(w).cast("long").alias("n"), "start", end.alias("end"), "text")


def srt(cues_: DataFrame) -> DataFrame:
    """(key, srt): SubRip text of each key's cues."""
    block = F.concat(F.col("n").cast("string"), F.lit("\n"), S.stamp(F.col("start")), F.lit(" --> "), S.stamp(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "")
    return cues_.groupBy("key").agg(joined.alias("srt"))


def vtt(cues_: DataFrame) -> DataFrame:
    """(key, vtt): WebVTT text of each key's cues."""
    safe = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    block = F.concat(S.stamp(F.col("start"), "."), F.lit(" --> "), S.stamp(F.col("end"), "."), F.lit("\n"), safe, F.lit("\n\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "")
    return cues_.groupBy("key").agg(F.concat(F.lit("WEBVTT\n\n"), joined).alias("vtt"))


def caption_ends(caps: DataFrame, total: str) -> DataFrame:
    """Captions whose end is the next one's start, the last one's the total."""
    w = Window.partitionBy("key").orderBy("start", "caption")
    return caps.withColumn("end", F.coalesce(F.lead("start").over(w), F.col(total)))


def repeated(effects: DataFrame, most: int) -> DataFrame:
    """(key, id, k, at, letter): an effect (t, repeat, gap) as its repeats."""
    return effects.select("key", "id", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("repeat"), F.lit(most)) - 1)).alias("k"), "t", "gap").select("key", "id", "k", (F.col("t") + F.col("k") * F.col("gap")).alias("at"))


def keystrokes(texts: DataFrame) -> DataFrame:
    """(key, i, k, piece): two letters of a text at a time."""
    return texts.select("key", "i", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(2))).alias("k")).select("key", "i", F.col("k").cast("long").alias("k"), F.substring(F.col("text"), F.col("k") + 1, F.lit(2)).alias("piece"))


def alternating(df: DataFrame, seed: int = 0) -> DataFrame:
    """Adds `side`: 0 and 1 by turns in order of time."""
    return df.withColumn("side", F.pmod(F.row_number().over(Window.partitionBy("key").orderBy("t", "id")) - 1 + seed, F.lit(2)).cast("long"))


def transitions(clips: DataFrame, settings: DataFrame) -> DataFrame:
    """(key, id, at, style): between neighbouring clips (key, id, s, e, kind) of different kinds that don't follow on in the
    source, with the style that `settings` (kind, style) names, if any."""
    w = Window.partitionBy("key").orderBy("s", "id")
    near = clips.withColumn("before", F.lag("kind").over(w)).withColumn("end", F.lag("e").over(w))
    cut = near.where(F.col("before").isNotNull() & (F.col("before") != F.col("kind")) & (F.col("end") != F.col("s")))
    return cut.join(settings, "kind", "left").select("key", "id", F.col("s").alias("at"), "style")


def cut_points(clips: DataFrame, grid: int) -> DataFrame:
    """(key, at, source, start): places where clips (key, at, length, source; whole frames) may be cut: where each starts, and
    where its source passes a multiple of `grid`, so that the same content is cut alike wherever it stands. Clips with nulls
    are left out."""
    first = (F.floor(F.col("source") / grid) + 1) * grid
    last = F.col("source") + F.col("length") - 1
    inner = F.when(first <= last, F.sequence(first, last, F.lit(grid).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    known = clips.where("at is not null and length is not null and source is not null").withColumns({"at": F.col("at").cast("long"), "source": F.col("source").cast("long"), "length": F.col("length").cast("long")})
    starts = known.select("key", "at", "source", F.lit(True).alias("start"))
    return starts.unionByName(known.select("key", "at", "source", F.explode(inner).alias("g")).select("key", (F.col("at") + F.col("g") - F.col("source")).alias("at"), F.col("g").alias("source"), F.lit(False).alias("start")))


def clip_times(clips: DataFrame, fps: float = 30.0) -> DataFrame:
    """(key, i, at, source, lasting) in seconds of clips (key, i, at, source, length in frames): a clip without a place starts
    where the one before ends. Clips without a source or a length above zero are left out.

    A place counts from the last clip that has one, with the lengths in between: two windows."""
    w = Window.partitionBy("key").orderBy("i")
    known = clips.where("source is not null and length > 0").withColumn("group", F.count("at").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("key", "group").orderBy("i")
    start = F.coalesce(F.first("at").over(inside), F.lit(0)) + F.coalesce(F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return known.select("key", "i", (start / fps).alias("at"), (F.col("source") / fps).alias("source"), (F.col("length") / fps).alias("lasting"))


def shifted(effects: DataFrame, by: int, low: int, high: int) -> DataFrame:
    """Effects (key, id, at) that start in [low, high), moved by `by` but not before 0; one without a time starts at 0."""
    at = F.coalesce("at", F.lit(0))
    return effects.where((at >= low) & (at < high)).select("key", "id", F.greatest(at + by, F.lit(0)).alias("at"))


def nearest_rows(rows: DataFrame, sure: DataFrame, k: int = 2) -> DataFrame:
    """(key, i, j): for each row (key, i) the k rows of `sure` (key, i) nearest in number, the earlier of equals.

    The sure rows of a key are ranked; a row's nearest are among the k before it and the k after it, so it meets 2k ranks by
    equality and no key makes pairs."""
    both = rows.select("key", "i", F.lit(1).alias("asks")).unionByName(sure.select("key", "i", F.lit(0).alias("asks")))
    rank = F.count_if(F.col("asks") == 0).over(Window.partitionBy("key").orderBy("i", "asks"))
    ranked = both.withColumn("rank", rank)
    asked = ranked.where("asks = 1").select("key", "i", F.explode(F.sequence(F.col("rank") - (k - 1), F.col("rank") + k)).alias("rank"))
    met = asked.join(ranked.where("asks = 0").select("key", F.col("i").alias("j"), "rank"), ["key", "rank"])
    near = F.row_number().over(Window.partitionBy("key", "i").orderBy(F.abs(F.col("i") - F.col("j")), "j"))
    return met.withColumn("near", near).where(F.col("near") <= k).select("key", "i", "j")
