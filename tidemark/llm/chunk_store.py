"""Token ids in a content-addressed store.

Each document's id stream is cut where a rolling hash of the last 16 ids says so; a chunk is named by the hash of its
bytes, unique chunks are stored once, and a recipe lists the chunks of each document in ascending doc_id order. A document's
Merkle root stands over its chunks; the manifest is a tree of FAN_OUT branches over all documents in order, so that no node
gathers more than so many rows, with the number of documents and ids below each node. Readers compute the whole tree anew
from the recipes and compare every node, check each document's chunks against its root and each chunk's bytes against its
name, so a lost, added, altered or misplaced chunk, recipe or node is an error. A store is a folder of three Parquet tables:
chunks (chunk, ids), recipes (doc_id, n_tokens, chunks, root, part) and manifest (level, node, documents, n_tokens, hash),
whose highest level has one node for the whole.

Defined cases. A null text is empty; an empty text is its end id alone. Rows with equal ids stay separate documents; a null
id comes first. Ids are kept in two bytes where the vocabulary allows, else in four. Extra columns are ignored; an empty
table gives an empty store.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .token_ids import CHARS_AT_ONCE, encoder, slices

VOCABULARY, END_ID = "byte_bpe_50k.json", 0
#: Ids in a chunk: at least, at most, and one cut in so many positions between; the rolling hash sees WINDOW ids.
LEAST, MOST, ONE_IN, WINDOW = 64, 4096, 512, 16
#: Chunks whose bytes a task remembers to have sent already.
MOST_SENT = 200_000
NAME_BYTES = 16
#: Branches of a node of the manifest.
FAN_OUT = 1024


def name_of(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()[:NAME_BYTES]


def merkle_root(names: list[bytes]) -> bytes:
    """Root of the binary hash tree over these names; an odd one out moves up as it is."""
    level = [hashlib.sha256(b"\0" + n).digest() for n in names] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[k] + level[k + 1]).digest() if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0]


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each position a hash of the WINDOW ids that end there."""
    h = (ids + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    width = 1
    while width < WINDOW:
        more = h.copy()
        more[width:] += h[:-width] << np.uint32(width)
        h, width = more, 2 * width
    return h


def cuts(candidates: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of ids[start:end], given the positions after which the rolling hash allows a cut."""
    out, at = [], start
    for c in [*candidates, end]:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST or c == end and c > at:
            out.append(c)
            at = c
    return out


def chunk_batches(vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, sent = encoder(vocabulary), end_id.to_bytes(4, "little"), set()
        kind = "<u2" if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for batch in batches:
            counts, recipes, roots, chunks = [], [], [], []
            for texts in slices(batch.column("text"), CHARS_AT_ONCE):
                packed = [x + end for x in encode(texts)]
                sizes = [len(x) // 4 for x in packed]
                ids = np.frombuffer(b"".join(packed), "<u4")
                hits = np.flatnonzero(rolling(ids) >> np.uint32(20) & np.uint32(ONE_IN - 1) == 0) + 1
                data, width, at = ids.astype(kind).tobytes(), int(kind[-1]), 0
                ends = np.cumsum(sizes)
                lo, hi = np.searchsorted(hits, ends - sizes, "right"), np.searchsorted(hits, ends, "left")
                for n, end_at, a, b in zip(sizes, ends.tolist(), lo, hi, strict=True):
                    names, new = [], []
                    for c in cuts(hits[a:b].tolist(), at, end_at):
                        payload = data[width * at : width * c]
                        names.append(name_of(payload))
                        if names[-1] not in sent:
                            if len(sent) >= MOST_SENT:
                                sent.clear()
                            sent.add(names[-1])
                            new.append({"chunk": names[-1], "ids": payload})
                        at = c
                    counts.append(n)
                    recipes.append(names)
                    roots.append(merkle_root(names))
                    chunks.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(recipes, pa.list_(pa.binary())), pa.array(roots, pa.binary()), pa.array(chunks, pa.list_(pa.struct([("chunk", pa.binary()), ("ids", pa.binary())])))],
                ["doc_id", "n_tokens", "chunks", "root", "new"],
            )

    return run


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encode whole texts and write a store at `path`.

    Texts are encoded once, into a table beside the store. Chunks meet by name with a partial aggregation before the
    shuffle, so a chunk that a third of all documents share arrives once from each task."""
    spark = docs.sparkSession
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = common.stored(texts.mapInArrow(chunk_batches(vocabulary, end_id), "doc_id long, n_tokens long, chunks array<binary>, root binary, new array<struct<chunk:binary,ids:binary>>"), "encoded")
    unique = encoded.select(F.explode("new").alias("x")).select("x.chunk", "x.ids").groupBy("chunk").agg(F.first("ids").alias("ids"))
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = common.ordered_store(encoded.select("doc_id", "n_tokens", "chunks", "root"), ["doc_id", "root"], "recipes", path=f"{path}/recipes")
    manifest(recipes).write.parquet(f"{path}/manifest")


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, node, documents, n_tokens, hash): the tree over all recipes in order; a level is made from the one below.

    Recipes that are equal in id and root are equal in all, so which of them comes first changes nothing."""
    placed = common.running_before(recipes.select("part", "doc_id", "root", "n_tokens", F.lit(1).cast("long").alias("documents")), ["doc_id", "root"], ["documents"])
    leaf = F.sha2(F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "n_tokens", F.hex("root")), 256)
    below = placed.select(F.col("documents_before").alias("at"), "documents", "n_tokens", leaf.alias("hash"))
    number, level, levels = recipes.count(), 0, []
    while True:
        number, level = -(-number // FAN_OUT), level + 1
        joined = F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"])), 256)
        nodes = below.groupBy(F.floor(F.col("at") / FAN_OUT).alias("node")).agg(F.sum("documents").alias("documents"), F.sum("n_tokens").alias("n_tokens"), joined.alias("hash"))
        nodes = common.stored(nodes.select(F.lit(level).alias("level"), "node", "documents", "n_tokens", "hash"), "manifest")
        levels.append(nodes)
        if number <= 1:
            return reduce(DataFrame.unionAll, levels)
        below = nodes.select(F.col("node").alias("at"), "documents", "n_tokens", "hash")


def check_manifest(recipes: DataFrame, path: str) -> None:
    """Raises unless the recipes give every node of the stored manifest, and no other."""
    columns = ["level", "node", "documents", "n_tokens", "hash"]
    own = manifest(recipes).select(*columns, F.lit(1).alias("own"))
    told = recipes.sparkSession.read.parquet(f"{path}/manifest").select(*columns, F.lit(1).alias("told"))
    for row in own.join(told, columns, "full").where("own is null or told is null").limit(1).collect():
        raise ValueError(f"the recipes and the manifest differ below node {row['node']} of level {row['level']}")


@cache
def crc_shift(log2: int) -> list[list[int]]:
    """Tables, one for each byte of it, for what a CRC-32 becomes when 2**log2 zero bytes follow."""
    if log2:
        t = crc_shift(log2 - 1)
        twice = lambda x: t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
        return [[twice(x) for x in row] for row in t]

    def byte_later(x: int) -> int:
        for _ in range(8):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return x

    return [[byte_later(v << 8 * k) for v in range(256)] for k in range(4)]


def crc_joined(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings put together."""
    log2 = 0
    while second_bytes and first:
        if second_bytes & 1:
            t = crc_shift(log2)
            first = t[0][first & 255] ^ t[1][first >> 8 & 255] ^ t[2][first >> 16 & 255] ^ t[3][first >> 24]
        second_bytes >>= 1
        log2 += 1
    return first ^ second


def checked_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sums = [], [], []
            for name, payload in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if name_of(payload) != name:
                    raise ValueError(f"chunk {name.hex()} doesn't have the bytes it is named by")
                ids = np.frombuffer(payload, f"<u{width}").astype("<u4")
                names.append(name)
                sizes.append(len(ids))
                sums.append(crc32(ids.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], ["chunk", "n", "crc"])

    return run


def joined_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for doc, n, root, parts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "parts")], strict=True):
            parts.sort(key=lambda p: p["seq"])
            if sum(p["n"] or 0 for p in parts) != n or merkle_root([p["chunk"] for p in parts]) != root:
                raise ValueError(f"document {doc}: its chunks don't give what its recipe says")
            total = 0
            for p in parts:
                total = crc_joined(total, p["crc"], 4 * p["n"])
            sums.append(total)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def recipes_of(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with `start`, the ids of all documents before, and a number for each row."""
    recipes = common.running_before(spark.read.parquet(f"{path}/recipes"), ["doc_id", "root"], ["n_tokens"])
    return recipes.withColumnRenamed("n_tokens_before", "start")


def id_width(vocabulary: str, end_id: int) -> int:
    return 2 if encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4


def verified(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    Every stored chunk is read, checked against its name and summed once, however many documents share it; a document's
    checksum is put together from its chunks' sums in the order of its recipe, and its Merkle root is compared."""
    sums = spark.read.parquet(f"{path}/chunks").mapInArrow(checked_chunks(width), "chunk binary, n long, crc long")
    recipes = recipes_of(spark, path)
    check_manifest(spark.read.parquet(f"{path}/recipes"), path)
    # start is unique: every document has at least its end id
    used = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("seq", "chunk")).join(sums, "chunk", "left")
    parts = used.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.collect_list(F.struct("seq", "chunk", "n", "crc")).alias("parts"))
    return parts.mapInArrow(joined_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """(doc_id, start, ids array<long>) of every document: chunks joined to recipes and put together, with the same checks."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc, n, root, parts in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "root", "parts")], strict=True):
                parts.sort(key=lambda p: p["seq"])
                if any(p["ids"] is None or name_of(p["ids"]) != p["chunk"] for p in parts) or merkle_root([p["chunk"] for p in parts]) != root:
                    raise ValueError(f"document {doc}: its chunks don't give what its recipe says")
                found.append(np.frombuffer(b"".join(p["ids"] for p in parts), f"<u{width}").astype(np.int64))
                if len(found[-1]) != n:
                    raise ValueError(f"document {doc}: {len(found[-1])} ids where its recipe says {n}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    check_manifest(spark.read.parquet(f"{path}/recipes"), path)
    used = recipes_of(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("chunks").alias("seq", "chunk")).join(spark.read.parquet(f"{path}/chunks"), "chunk", "left")
    parts = used.groupBy("start").agg(*[F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root")], F.collect_list(F.struct("seq", "chunk", "ids")).alias("parts"))
    return parts.mapInArrow(unpack, "doc_id long, start long, ids array<long>")


def op4_content_addressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.work_path(spark, "token-store")
    write(common.table(spark, sf_dir, "documents"), path)
    return verified(spark, path, id_width(VOCABULARY, END_ID))
