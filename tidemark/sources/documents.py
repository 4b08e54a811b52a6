"""Readers and writers of documents: JSON with an envelope, word lists from recognisers, probes, signals, subtitles.

Readers take a path that Spark opens and give rows; what doesn't parse gives nulls or no row, never an error."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with its file's name; an envelope {id, data, version} is opened, a bare document taken as is."""
    wrapped = f"struct<id:string,version:string,data:struct<{schema}>>"
    raw = spark.read.text(path, wholetext=True).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    both = raw.select("file", F.from_json("value", wrapped).alias("w"), F.from_json("value", f"struct<{schema}>").alias("b"))
    return both.select("file", "w.id", F.coalesce("w.data", "b").alias("d")).select("file", "id", "d.*")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files, trimmed."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.trim("value").alias("text"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) in order of name; contents aren't read."""
    f = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return f.orderBy("file")


def frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(word, n, share) of dictionaries {word: count}, gzipped or not."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,bigint>").alias("m"))
    each = raw.select(F.explode("m").alias("word", "n"))
    total = each.agg(F.sum("n").alias("total"))
    return each.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def voice_activity(log: Column) -> Column:
    """array<struct<a, b>> in seconds from lines 'start = a, end = b' in hundredths."""
    pattern = F.lit(r"start = ([\d.]+), end = ([\d.]+)")
    pairs = F.arrays_zip(F.regexp_extract_all(log, pattern, 1).alias("a"), F.regexp_extract_all(log, pattern, 2).alias("b"))
    return F.transform(pairs, lambda p: F.struct((p["a"].try_cast("double") / 100).alias("a"), (p["b"].try_cast("double") / 100).alias("b")))


def words_of_tokens(tokens: DataFrame, after: float = -1.0, tail: float = 0.16) -> DataFrame:
    """(key, n, w, a, b, p): sub-word tokens (key, i, token, t, logprob) as words: a leading space opens one, its confidence
    is that of its least sure token, and words that start before `after` are left out."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = tokens.withColumn("n", F.sum(F.when(F.col("token").startswith(" "), 1).otherwise(0)).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), "")
    per = placed.groupBy("key", "n").agg(F.trim(text).alias("w"), F.min("t").alias("a"), (F.max("t") + tail).alias("b"), F.exp(F.min("logprob")).alias("p"))
    return per.where((F.col("w") != "") & (F.col("a") >= after))


def duration(probe: Column) -> Column:
    """Seconds of 'Duration: h:m:s.f' in a probe's text, 0 where there is none."""
    part = lambda k: F.regexp_extract(probe, r"Duration: (\d+):(\d+):([\d.]+)", k).try_cast("double")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0.0))


def coded_size(probe: Column) -> Column:
    """struct<w, h> of the first 'Video: … WxH'."""
    part = lambda k: F.nullif(F.regexp_extract(probe, r"Video:.*?[ ,](\d{2,5})x(\d{2,5})", k), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("w"), part(2).alias("h"))


def display_size(probe: Column) -> Column:
    """The coded size by the pixel's shape and turned by a rotation of a quarter."""
    size = coded_size(probe)
    sar = lambda k: F.coalesce(F.nullif(F.regexp_extract(probe, r"SAR (\d+):(\d+)", k), F.lit("")).try_cast("double"), F.lit(1.0))
    wide = F.round(size["w"] * sar(1) / sar(2)).cast("int")
    turn = F.coalesce(F.nullif(F.regexp_extract(probe, r"rotation of (-?\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
    turned = F.pmod(turn, F.lit(180)) == 90
    return F.struct(F.when(turned, size["h"]).otherwise(wide).alias("w"), F.when(turned, wide).otherwise(size["h"]).alias("h"))


def flat_fields(line: Column, depth: int = 3) -> Column:
    """Comma-separated fields without what stands in parentheses, nested up to `depth`."""
    for _ in range(depth):
        line = F.regexp_replace(line, r"\([^()]*\)", "")
    return F.transform(F.split(line, ","), lambda x: F.trim(x))


def scene_times(log: Column) -> Column:
    """Distinct times of 'pts_time:…' in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(log, F.lit(r"pts_time:([\d.]+)"), 1), lambda x: x.try_cast("double"))))


def query_fields(url: Column) -> Column:
    """array<struct<k, v>> of a URL's query, decoded, in order."""
    parts = F.filter(F.split(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.url_decode(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), F.url_decode(F.split_part(p, F.lit("="), F.lit(2))).alias("v")))


def signals(spark: SparkSession, path: str, block: float = 0.1) -> DataFrame:
    """(file, rate, n, samples): 16-bit WAV files as blocks of `block` seconds of mono samples in [-1, 1)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, data in zip(pdf["file"], pdf["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(data)) as w:
                        rate, channels = w.getframerate(), w.getnchannels()
                        x = np.frombuffer(w.readframes(w.getnframes()), "<i2").astype(np.float32) / 32768
                except (wave.Error, EOFError):
                    continue  # not a signal: no row
                x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1)
                size = max(1, round(rate * block))
                parts = [x[k : k + size] for k in range(0, len(x), size)]
                yield pd.DataFrame({"file": [name] * len(parts), "rate": rate, "n": range(len(parts)), "samples": parts})

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInPandas(run, "file string, rate int, n long, samples array<float>")


def write_subtitles(texts: DataFrame, path: str, column: str = "srt") -> None:
    """A text file for each part of `texts`; Spark's committer puts them in place whole."""
    texts.select(column).write.mode("overwrite").text(path)


def written_whole(df: DataFrame, path: str) -> None:
    """JSON lines, committed as a whole or not at all."""
    df.write.mode("overwrite").json(path)


def snapshots(versions: DataFrame, keep: int = 40) -> DataFrame:
    """The newest `keep` versions (name, saved) to hold on to."""
    return versions.orderBy(F.desc("saved"), F.desc("name")).limit(keep)


def publish_parts(files: DataFrame, most: int = 14 << 20) -> DataFrame:
    """(file, part, offset, bytes): files (file, bytes) cut into parts of at most `most` bytes."""
    each = files.select("file", F.col("bytes").alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(most).cast("long"))).alias("offset"))
    return each.select("file", F.expr(f"offset div {most}").alias("part"), "offset", F.least(F.lit(most), F.col("size") - F.col("offset")).alias("bytes"))
