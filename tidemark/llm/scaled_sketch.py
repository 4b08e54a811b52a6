"""Document fingerprints that keep every shingle hash below a fixed fraction of the hash range.

A shingle is a run of WIDTH code points (a shorter text: all of it). The kept hashes of two sketches are comparable however
unequal the texts, and the union of sketches is the sketch of the union, so sketches of parts merge. Likeness is the
estimated containment of the smaller sketch in the larger. A text none of whose hashes lies below the bound keeps its
least one, so that only an empty text has an empty sketch.

Defined cases. A null text is empty; the sketch of an empty text is empty, and its likeness is 1 to an empty one and 0 to
any other. Rows with equal ids follow each other by the hash of their text, null ids come last in descending order; a
table of one row is its own next document. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Code points of a shingle (a power of two), the kept fraction, and bits of a hash that are kept.
WIDTH, ONE_IN, BITS = 16, 16, 32


def sketch(text: str) -> np.ndarray:
    """The kept hashes, ascending, without repeats."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.zeros(0, np.uint32)
    h = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    base, width = np.uint64(0xD6E8FEB86659FD93), 1
    if len(points) < WIDTH:
        total = np.uint64(len(points))
        for x in h.tolist():
            total = np.uint64((int(total) * int(base) + x) & 0xFFFFFFFFFFFFFFFF)
        h = np.array([total], np.uint64)
    else:
        while width < WIDTH:
            h = h[:-width] * base + h[width:]
            with np.errstate(over="ignore"):
                base = base * base
            width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    top = (h >> np.uint64(64 - BITS)).astype(np.uint32)
    kept = np.unique(top[top < (1 << BITS) // ONE_IN])
    return kept if len(kept) else top.min(keepdims=True)


def encoded(kept: np.ndarray) -> str:
    return kept.astype(">u4").tobytes().hex()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together."""
    both = np.union1d(a, b)
    below = both[both < (1 << BITS) // ONE_IN]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return float((large[at] == small).mean())


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) code points replaced by the first as many of the next one's, or all it has."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order within a bucket; a row is done when the next one of its bucket is seen. Rows that only serve as
    the next one of another bucket's last row are marked and give no row."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        rows = []
        for bucket, guest, doc, text in zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            own = sketch(text)
            if held is not None and held[0] == bucket:
                _, before, before_text, before_sketch = held
                new = edited(before_text, text)
                new_sketch = sketch(new)
                rows.append((before, len(before_text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), encoded(before_sketch), encoded(new_sketch), likeness(before_sketch, new_sketch), likeness(before_sketch, own)))
            held = None if guest else (bucket, doc, text, own)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names)


def ranked(x: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at or below x: by runs of them, then inside one run, so that a row looks at about
    twice the square root of their number. The bounds are a constant of the plan."""
    if not bounds:
        return F.lit(0)
    size = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[k : k + size] for k in range(0, len(bounds), size)]
    heads = F.from_json(F.lit(json.dumps([r[0] for r in runs])), "array<bigint>")
    inside = F.from_json(F.lit(json.dumps(runs)), "array<array<bigint>>")
    run = F.size(F.filter(heads, lambda b: b <= x)) - 1  # -1: below all bounds
    return F.when(run < 0, F.lit(0)).otherwise(run * size + F.size(F.filter(F.get(inside, run), lambda b: b <= x)))


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of each document and of its edited text, with their likeness and that to the next document.

    Documents are dealt by ranges of doc_id that quantiles fix beforehand, and each range's first document goes to the
    range before it as well: one shuffle of the texts, and no task sees more than its range."""
    spark = docs.sparkSession
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # several ranges for each partition, so that their hashes deal them out evenly
    buckets = buckets or 8 * common.shuffle_parts(spark)
    shares = [k / buckets for k in range(1, buckets)]
    bounds = sorted({int(b) for b in texts.approxQuantile("doc_id", shares, 0.25 / buckets)}) if shares else []
    # descending order: bucket 0 holds the largest ids, null ids come last
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds) + 1)).otherwise(F.lit(len(bounds)) - ranked(F.col("doc_id"), bounds))
    placed = texts.withColumn("bucket", bucket.cast("int"))
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    first = F.struct(F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)).alias("rank"), tie.alias("tie"))
    heads = placed.groupBy("bucket").agg(F.min(first).alias("head"))  # a row for each bucket
    following = Window.orderBy("bucket")
    last = Window.orderBy(F.desc("bucket"))
    around = heads.select("bucket", "head", F.lag("bucket").over(following).alias("before"), F.first("bucket").over(last).alias("final"))
    around = around.select("bucket", "head", F.coalesce("before", "final").alias("to"))
    joined = placed.join(F.broadcast(around), "bucket")
    is_head = (F.coalesce(-F.col("doc_id"), F.lit(2**63 - 1)) == F.col("head.rank")) & (tie == F.col("head.tie"))
    visits = F.when(is_head, F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("bucket"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest"))))
    sent = joined.select("doc_id", "text", F.explode(visits).alias("v")).select("v.bucket", "v.guest", "doc_id", "text")
    ordered = sent.repartition(common.shuffle_parts(spark), "bucket").sortWithinPartitions("bucket", "guest", F.desc_nulls_last("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))
    return ordered.select("bucket", (F.col("guest") == 1).alias("guest"), "doc_id", "text").mapInArrow(pair_batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.table(spark, sf_dir, "documents"))
