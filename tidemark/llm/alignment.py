"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenises: for each text the ids of both tokenizers, the byte offsets at which their tokens end, and for each byte
the number of the token that covers it. All else is Spark's functions over these arrays. Ends that both have
(array_intersect) cut the tokens into groups; the place of a common end in either side's ids is one look-up by byte. All
pairs within a group are links: the first ids of all groups give one each, the groups of more than one id, which ends of only
one side tell (array_except), the others. A pair's count, the number of documents that hold it, is one grouping over the
documents' distinct pairs. The HEAD most frequent pairs, a fixed number, are broadcast; links of any other pair are joined to
their counts by a shuffle, in which no pair can be frequent.

Defined cases. A null or empty text, and one whose tokens of either side don't spell a space and the text (an unknown
character, U+2581 in the text), has no tokens: zeros and an empty groups text. Rows with equal ids stay separate documents
and count separately, a null id stays null, repeated rows are repeated. Very long texts are aligned whole, with two numbers
for each byte while they are. Strings of special tokens inside texts are plain text. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pieces import piece_model
from .token_ids import encoder, slices, token_bytes

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A pair of ids is one number: the first id times this, plus the second.
IDS = 1 << 20
#: Pieces of text whose ids a worker remembers for the first tokenizer (the second has a memory of its own), and characters
#: of text whose numbers are sent on together: a character has two numbers of four bytes besides the tokens.
MOST_PIECES, CHARS_AT_ONCE = 200_000, 250_000
#: The most frequent pairs, which every task gets.
HEAD = 1 << 17


FIELDS = ("a", "a_ends", "a_of", "b", "b_ends", "b_of")


def lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype("<i4")
    flat = np.concatenate(values) if values else np.array([], "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype("<i4")))


def tokenised(byte_level: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, model = encoder(byte_level, special=False, most=MOST_PIECES), piece_model(pieces)
        spelt = token_bytes(byte_level), [b or b"" for b in model.bytes_of]
        if max(map(len, spelt)) > IDS:
            raise ValueError(f"vocabularies of more than {IDS} entries")
        lengths = [np.array([len(b) for b in table], "<i4") for table in spelt]
        none = np.array([], "<i4")
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text"), CHARS_AT_ONCE):
                columns: list[list[np.ndarray]] = [[] for _ in FIELDS]
                for text, first, second in zip(texts, encode([f" {t}" for t in texts]), model.encode_all(texts), strict=True):
                    sides = [np.frombuffer(first, "<u4"), np.frombuffer(second, "<u4")]
                    whole = f" {text}".encode()
                    if not text or any(b"".join(map(table.__getitem__, ids.tolist())) != whole for ids, table in zip(sides, spelt, strict=True)):
                        sides = [none, none]
                    for k, ids in enumerate(sides):
                        sizes = lengths[k][ids]
                        columns[3 * k].append(ids)
                        columns[3 * k + 1].append(np.cumsum(sizes))
                        columns[3 * k + 2].append(np.repeat(np.arange(1, len(ids) + 1, dtype="<i4"), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(texts)), *map(lists, columns)], ["doc_id", *FIELDS])
                at += len(texts)

    return run


def tokens(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id and, for both tokenizers over a space and the text: ids (a, b), byte offsets of their ends (a_ends, b_ends), and
    for each byte which token covers it, from 1 (a_of, b_of)."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(tokenised(byte_level, pieces), ", ".join(["doc_id long", *[f"{name} array<int>" for name in FIELDS]]))


def settled(df: DataFrame, **new: Column) -> DataFrame:
    """With new columns, each worked out once a row: Spark would otherwise move a column's expression into the functions
    that later use it element by element. Going through inline() keeps it where it is."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in new.items()]))))


def numbers(n: Column) -> Column:
    """0 to n - 1."""
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1))


def cut(tokens: DataFrame) -> DataFrame:
    """doc_id, a, b with `a_at` and `b_at`, where each group begins in either side's ids and after the last where it ends, and
    `wide`, the numbers of the groups that have more than one id of either side."""
    sides = ("a", "b")
    ends = tokens.select(
        "doc_id", "a", "b", "a_of", "b_of", F.array_intersect("a_ends", "b_ends").alias("ends"), F.array_except("a_ends", "b_ends").alias("a_own"), F.array_except("b_ends", "a_ends").alias("b_own")
    )
    stops = lambda side: F.concat(F.array(F.lit(0)), F.transform("ends", lambda e: F.get(f"{side}_of", e - 1)))
    # of the tokens that end up to an own end, all but the own ones so far end at common ends: the groups before
    extra = lambda side: F.transform(f"{side}_own", lambda e, j: F.get(f"{side}_of", e - 1) - j - 1)
    out = settled(ends, wide=F.array_union(*map(extra, sides)), **{f"{side}_at": stops(side) for side in sides})
    return out.select("doc_id", "a", "b", "a_at", "b_at", "wide")


def members(side: str, k: Column) -> Column:
    """The ids of a side in group k; a slice() would cost several times as much."""
    return F.transform(F.sequence(F.get(f"{side}_at", k), F.get(f"{side}_at", k + 1) - 1), lambda i: F.get(side, i))


def groups(k: Column) -> Column:
    """Over what cut() gives, for group numbers: an array of (a, b), the ids of both sides between neighbouring common ends."""
    return F.transform(k, lambda i: F.struct(members("a", i).alias("a"), members("b", i).alias("b")))


def linked(cuts: DataFrame) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (of a1,a2|b1;a3|b2,b3), and all links, each as one number."""
    n = F.size("a_at") - 1
    first = lambda side: F.transform(F.slice(f"{side}_at", 1, n), lambda s: F.get(side, s))
    told = settled(cuts, a_first=first("a"), b_first=first("b"))
    pair = lambda x, y: x.cast("long") * IDS + y
    last_is_first = lambda side, k: F.get(f"{side}_at", k + 1) - F.get(f"{side}_at", k) == 1
    ids = lambda side, k: F.array_join(members(side, k).cast("array<string>"), ",")
    text = lambda side, k: F.when(last_is_first(side, k), F.get(f"{side}_first", k).cast("string")).otherwise(ids(side, k))
    words = F.array_join(F.transform(numbers(n), lambda k: F.concat(text("a", k), F.lit("|"), text("b", k))), ";")
    # of a group of many ids, the pair of the first two is among the pairs of all groups' first ids already
    others = lambda k: F.flatten(F.transform(members("a", k), lambda x, i: F.transform(F.filter(members("b", k), lambda y, j: (i > 0) | (j > 0)), lambda y: pair(x, y))))
    links = F.concat(F.zip_with("a_first", "b_first", pair), F.flatten(F.transform("wide", others)))
    size = lambda c: F.size(c).cast("long")
    out = told.select("doc_id", size("a").alias("n_a"), size("b").alias("n_b"), n.cast("long").alias("n_groups"), F.when(n == 0, F.lit("")).otherwise(F.sha2(words.cast("binary"), 256)).alias("groups_sha256"), links.alias("links"))
    return out.withColumn("n_links", size("links"))


def pair_counts(documents: DataFrame) -> DataFrame:
    """pair, count: how many documents hold it linked; best: no pair of the same first id has more."""
    counts = documents.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))
    first = F.floor(F.col("pair") / IDS)
    most = counts.groupBy(first.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", first).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES, head: int = HEAD) -> DataFrame:
    """A row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    numbered = linked(cut(tokens(docs, byte_level, pieces))).withColumn("row", F.monotonically_increasing_id())
    documents = common.stored(numbered, "alignment-links")
    counts = common.stored(pair_counts(documents), "alignment-counts")
    frequent = common.stored(counts.orderBy(F.desc("count"), "pair").limit(head), "alignment-head")
    others = counts.join(F.broadcast(frequent.select("pair")), "pair", "left_anti")
    links = documents.select("row", F.explode("links").alias("pair"))
    by_head = links.join(F.broadcast(frequent), "pair")
    by_join = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(others, "pair")
    sums = by_head.unionByName(by_join).groupBy("row").agg(
        F.sum(F.col("best").cast("long")).alias("n_best"),
        F.sum("count").alias("count_sum"),
    )
    none = F.lit(0).cast("long")
    return documents.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(common.table(spark, sf_dir, "documents"))
