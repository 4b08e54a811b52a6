"""Packing by power-of-two decomposition.

A document of T tokens becomes T div 2048 pieces of 2048 and one piece for each binary digit of the rest, longest first.
Every piece is a sequence of its own, so no sequence crosses documents, none needs padding, and sequences of one length
form a bucket: sequence ids run through the buckets from the longest to the shortest, in each by ascending doc_id.

Defined cases. A null text is empty; an empty text is its end id alone, one sequence of length 1. Rows with equal ids stay
separate documents; a null id comes first. Very long texts have as many 2048-pieces as they need. Extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_ids import CHARS_AT_ONCE, encoder, slices

VOCABULARY, END_ID, LONGEST_LOG2 = "word_bpe_49k.json", 1, 11


def piece_lengths(tokens: int, longest_log2: int) -> list[int]:
    """Powers of two that add up to `tokens`, longest first."""
    longest = 1 << longest_log2
    return [longest] * (tokens // longest) + [1 << k for k in range(longest_log2 - 1, -1, -1) if tokens >> k & 1]


def piece_batches(vocabulary: str, end_id: int, longest_log2: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), end_id.to_bytes(4, "little")
        kind = pa.list_(pa.struct([("crc", pa.int64()), ("ids", pa.binary())]))
        for batch in batches:
            tokens, pieces = [], []
            for texts in slices(batch.column("text"), CHARS_AT_ONCE):
                for ids in encode(texts):
                    ids += end
                    tokens.append(len(ids) // 4)
                    at, own = 0, []
                    for n in piece_lengths(tokens[-1], longest_log2):
                        part = ids[4 * at : 4 * (at + n)]
                        own.append({"crc": crc32(part), "ids": part if keep_ids else None})
                        at += n
                    pieces.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(pieces, kind)], ["doc_id", "doc_tokens", "pieces"])

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, longest_log2: int = LONGEST_LOG2, keep_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if kept.

    Only token counts and checksums (with keep_ids the ids too) are moved: they are written once in order of doc_id, and a
    piece's place in its bucket is a running count over that order."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = texts.mapInArrow(piece_batches(vocabulary, end_id, longest_log2, keep_ids), "doc_id long, doc_tokens long, pieces array<struct<crc:long,ids:binary>>")
    # written before they are dealt by ranges: finding the ranges reads its input once more
    placed = common.ordered_store(common.stored(cut, "packing-pieces"), ["doc_id", "doc_tokens"], "packing")
    classes = [f"n{k}" for k in range(longest_log2 + 1)]
    counted = placed.select("*", *[F.shiftright("doc_tokens", k).bitwiseAND(1).alias(f"n{k}") for k in range(longest_log2)], F.shiftright("doc_tokens", longest_log2).alias(f"n{longest_log2}"))
    totals = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in classes]).first()
    base = {longest_log2: 0}
    for k in range(longest_log2 - 1, -1, -1):
        base[k] = base[k + 1] + totals[f"n{k + 1}"]
    ranked = common.running_before(counted, ["doc_id", "doc_tokens"], classes)
    first = F.array(*[F.col(f"n{k}_before") + F.lit(base[k]) for k in range(longest_log2 + 1)])
    each = ranked.select("doc_id", "doc_tokens", F.col(f"n{longest_log2}").alias("full"), first.alias("first"), F.posexplode("pieces").alias("j", "piece"))
    # the digit a piece stands for: the (j - full)-th one of the rest's ones, from the highest
    digits = F.array(*[F.when(F.shiftright("doc_tokens", k).bitwiseAND(1) == 1, F.lit(k)) for k in range(longest_log2 - 1, -1, -1)])
    log2 = F.when(F.col("j") < F.col("full"), F.lit(longest_log2)).otherwise(F.get(F.array_compact(digits), (F.col("j") - F.col("full")).cast("int")))
    each = each.withColumn("log2", log2)
    whole = F.col("log2") == longest_log2
    return each.select(
        "doc_id",
        F.when(whole, F.col("j").cast("long") * (1 << longest_log2)).otherwise(F.expr("shiftleft(shiftright(doc_tokens, log2 + 1), log2 + 1)")).alias("start"),
        F.expr("shiftleft(1L, log2)").alias("length"),
        F.col("piece.crc").alias("ids_crc32"),
        "doc_tokens",
        (F.get("first", F.col("log2")) + F.when(whole, F.col("j")).otherwise(F.lit(0))).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *([F.col("piece.ids").alias("ids")] if keep_ids else []),
    )


def op6_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
