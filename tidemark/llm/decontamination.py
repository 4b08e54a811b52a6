"""Benchmark decontamination by SimHash over item-sized windows.

Every window of a document with as many words as a benchmark item gets a SimHash of its five-word shingles, 128 bits. Items
are indexed under their size and each of eight blocks of sixteen bits, with all values within one bit; a window asks for all
values within two bits of its own. Two fingerprints within RADIUS bits differ in at most three bits of some block, so every
one is found (at a shingle similarity of 0.8 some 19 bits differ, with a deviation of 4: one pair in a thousand lies beyond).
The pairs found are verified by the exact weighted Jaccard similarity of their shingles, told by 64-bit hashes.

A shingle of an item weighs one over the number of different items that hold it, counted over the whole benchmark, so that
phrases common to many items count for little. A shingle that the item doesn't hold weighs as much as the item's own do on
average, so that an edit costs an item of common phrases no more than another one.

A window whose similarity to an item reaches t holds shingles of items of its size with at least t/(1-t) times the least
weight that its other shingles can have. Only windows that do are fingerprinted, which loses none: for most documents that
is no window at all. Items go to the tasks in blocks of bounded size, each with a pass over the documents.

Defined cases. Words are runs of letters and digits in lower case. A null or empty text has no match; a document shorter
than an item is one window; very long texts are scanned whole. An item with fewer than five words has no shingle and is
never matched; null items likewise. Rows with equal or null ids stay separate rows; equal items each get their own rows, and
count as one for the weights. Of equally similar windows the first counts. Extra columns are ignored by leaks() and kept by
clean(). Empty tables give no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 31
#: Blocks of a fingerprint and their bits; bits that differ from an item's block in the index, and from a window's when asked.
BLOCKS, BLOCK_BITS, STORED, ASKED = 8, 16, 1, 2
#: Words of the items that go to the tasks at a time, about 50 bytes each in a task's memory (an item that is longer goes
#: alone), and windows looked up at a time.
WORDS_A_BLOCK, WINDOWS_AT_ONCE = 2_000_000, 1024
WORD = re.compile(r"[^\W_]+")
#: Words whose hash a worker remembers.
MOST_WORDS = 500_000
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key of the SHINGLE words that start at each position."""
    n = len(hashes) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    key = hashes[:n].copy()
    for k in range(1, SHINGLE):
        key = (key ^ (key >> np.uint64(31))) * FACTOR + hashes[k : n + k]
    key ^= key >> np.uint64(29)
    return key * FACTOR


def spins(keys: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of two remixed copies of each key, so that near keys don't share bits."""
    x = keys ^ (keys >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    y = x * FACTOR
    y ^= y >> np.uint64(29)
    return 2 * np.unpackbits(np.stack((x, y), axis=1).astype(">u8").view(np.uint8).reshape(-1, 16), axis=1).astype(np.int32) - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as eight blocks of sixteen bits, from the sums of each bit."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def flips(most: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(BLOCK_BITS), k)], np.int64)


class Index:
    """A block of benchmark items as every task holds it: (ids, words, shingle keys) of different items, and the number of
    items of the whole benchmark that hold a key, for keys that more than one holds."""

    def __init__(self, items: list[tuple[list[int], int, np.ndarray]], shared: dict[int, int]) -> None:
        self.ids = [ids for ids, _, _ in items]
        self.size_of = np.array([size for _, size, _ in items], np.int64)
        self.sizes, self.at_size = np.unique(self.size_of, return_inverse=True)
        self.own = []
        for _, _, keys in items:
            distinct, counts = np.unique(keys, return_counts=True)
            weights = 1.0 / np.array([shared.get(k, 1) for k in distinct.tolist()])
            whole = float((weights * counts).sum())
            self.own.append((distinct, counts, weights, whole, whole / len(keys)))
        # each key with the sizes of the items that hold it
        pairs = np.unique(np.concatenate([np.stack((own[0], np.full(len(own[0]), z, np.uint64)), axis=1) for own, z in zip(self.own, self.at_size.tolist(), strict=True)]), axis=0)
        self.keys, self.first = np.unique(pairs[:, 0], return_index=True)
        self.ends, self.key_sizes = np.append(self.first[1:], len(pairs)), pairs[:, 1].astype(np.int64)
        self.weights = 1.0 / np.array([shared.get(k, 1) for k in self.keys.tolist()])
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True
        self.lightest = np.full(len(self.sizes), np.inf)
        np.minimum.at(self.lightest, self.at_size, [own[4] for own in self.own])
        self.prints = np.concatenate([packed(spins(keys).sum(axis=0)[None, :]) for _, _, keys in items])
        self.blocks = []
        for b in range(BLOCKS):
            values = (self.at_size[:, None] << BLOCK_BITS | self.prints[:, b].astype(np.int64)[:, None] ^ flips(STORED)[None, :]).ravel()
            order = np.argsort(values, kind="stable")
            self.blocks.append((values[order], order // len(flips(STORED))))

    def within(self, prints: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): all items of the z-th size whose fingerprints are within RADIUS bits of a window's."""
        pairs = [np.zeros(0, np.int64)]
        for b, (values, items) in enumerate(self.blocks):
            asked = (z << BLOCK_BITS | prints[:, b].astype(np.int64)[:, None] ^ flips(ASKED)[None, :]).ravel()
            lo, hi = np.searchsorted(values, asked, "left"), np.searchsorted(values, asked, "right")
            some = np.flatnonzero(hi > lo)
            n = hi[some] - lo[some]
            at = np.repeat(lo[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.repeat(some // len(flips(ASKED)), n) * len(self.ids) + items[at])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair // len(self.ids), pair % len(self.ids)
        near = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64) <= RADIUS
        return window[near], item[near]

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Exact weighted Jaccard similarity of the shingles of an item and a window, counted with repeats."""
        own, counts, weights, whole, other = self.own[item]
        keys, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        held = own[at] == keys
        at, m, n = at[held], n[held], n[~held]
        low = (weights[at] * np.minimum(counts[at], m)).sum()
        return float(low / (whole + (weights[at] * np.maximum(0, m - counts[at])).sum() + other * n.sum()))

    def matches(self, n_words: int, keys: np.ndarray, at: np.ndarray, of: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item → (similarity, first word, words) of its best window, the first of equals. at: places of the shingles that
        items hold, of: the places of their keys in the index."""
        best: dict[int, tuple[float, int, int]] = {}
        n = self.ends[of] - self.first[of]
        place = np.repeat(np.arange(len(at)), n)
        sizes = self.key_sizes[np.repeat(self.first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        order = np.argsort(sizes, kind="stable")
        found, begins = np.unique(sizes[order], return_index=True)
        for z, own_places in zip(found.tolist(), np.split(place[order], begins[1:]), strict=True):
            size = int(self.sizes[z])
            span = min(size, n_words) - SHINGLE + 1
            bound = SIMILARITY / (1 - SIMILARITY) * self.lightest[z]
            if len(own_places) * (1 + bound) * (1 + 1e-9) < bound * span:
                continue
            held = np.zeros(len(keys))
            held[at[own_places]] = self.weights[of[own_places]]
            own = np.concatenate(([0.0], np.cumsum(held)))
            other = np.concatenate(([0], np.cumsum(held == 0)))
            starts = np.arange(len(keys) - span + 1)
            starts = starts[(own[starts + span] - own[starts]) * (1 + 1e-9) >= bound * (other[starts + span] - other[starts])]
            for some in np.split(starts, range(WINDOWS_AT_ONCE, len(starts), WINDOWS_AT_ONCE)):
                if not len(some):
                    continue
                first, last = int(some[0]), int(some[-1]) + span
                sums = np.concatenate((np.zeros((1, BLOCKS * BLOCK_BITS), np.int32), np.cumsum(spins(keys[first:last]), axis=0, dtype=np.int32)))
                for w, i in zip(*self.within(packed(sums[some - first + span] - sums[some - first]), z), strict=True):
                    s, i = int(some[w]), int(i)
                    got = self.similarity(i, keys[s : s + span])
                    if got >= SIMILARITY - 1e-9 and got > best.get(i, (0.0,))[0]:
                        best[i] = (got, s, min(size, n_words))
        return best


def scanned(index: Index, texts: list[str], hashes: Hashes) -> list[dict[int, tuple[float, int, int]]]:
    """matches() of each text; shingles of all texts are looked up together."""
    lists = [words_of(t) for t in texts]
    sizes = [len(w) for w in lists]
    every = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, sum(sizes))
    keys = shingle_keys(every)
    hit = np.flatnonzero(index.filter[keys >> np.uint64(44)])
    of = np.minimum(np.searchsorted(index.keys, keys[hit]), len(index.keys) - 1)
    real = index.keys[of] == keys[hit]
    hit, of = hit[real], of[real]
    out, begin = [], 0
    for words, n in zip(lists, sizes, strict=True):
        shingles = n - SHINGLE + 1
        a, b = np.searchsorted(hit, (begin, begin + max(0, shingles)))
        out.append(index.matches(len(words), keys[begin : begin + shingles], hit[a:b] - begin, of[a:b]) if b > a else {})
        begin += n
    return out


def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for batch in batches:
        words = [words_of(t.as_py() or "") for t in batch.column("text")]
        keys = [shingle_keys(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))).view(np.int64) for w in words]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["item_id", "n_words", "keys"])


def indices(benchmark: DataFrame) -> Iterator[Index]:
    """Blocks of items, each of bounded size, in order of item_id. Counts of items are over the whole benchmark."""
    items = common.only(benchmark, "item_id", "text").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    every = items.mapInArrow(shingled, "item_id long, n_words long, keys array<long>").where(F.size("keys") > 0).withColumn("same", F.xxhash64("keys"))
    placed = common.ordered_store(common.stored(every, "benchmark-items"), ["item_id", "same"], "benchmark")
    placed = common.running_before(placed, ["item_id", "same"], ["n_words"]).withColumn("block", F.floor(F.col("n_words_before") / WORDS_A_BLOCK))
    placed = common.stored(placed.select("block", "item_id", "n_words", "same", "keys"), "benchmark-blocks")
    own = placed.select("block", "same", F.explode(F.array_distinct("keys")).alias("key"))
    shared = common.stored(own.select("same", "key").distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "benchmark-shared")
    for block in range((placed.agg(F.max("block")).first()[0] if placed.head(1) else -1) + 1):
        # a block's rows and the counts of its own keys: bounded by WORDS_A_BLOCK
        rows = placed.where(F.col("block") == block).select("item_id", "n_words", "same", "keys").toArrow()
        counts = own.where(F.col("block") == block).select("key").distinct().join(shared, "key").toArrow()
        held = dict(zip(counts.column("key").to_numpy().view(np.uint64).tolist(), counts.column("n").to_pylist(), strict=True))
        different: dict[int, tuple[list[int], int, np.ndarray]] = {}
        for item, size, same, keys in zip(rows.column("item_id").to_pylist(), rows.column("n_words").to_pylist(), rows.column("same").to_pylist(), rows.column("keys"), strict=True):
            different.setdefault(same, ([], size, keys.values.to_numpy().view(np.uint64)))[0].append(item)
        if different:
            yield Index(list(different.values()), held)


CHARS_AT_ONCE = 1_000_000


def runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in runs of about CHARS_AT_ONCE characters; null is empty."""
    first, texts, size = 0, [], 0
    for k, text in enumerate(column):
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size > CHARS_AT_ONCE:
            yield first, texts
            first, texts, size = k + 1, [], 0
    if texts:
        yield first, texts


LEAKS = "doc_id long, item_id long, first_word long, n_words long, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity): for each document and item its best matching window."""
    sc = docs.sparkSession.sparkContext
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                ids, rows = batch.column("doc_id").to_pylist(), []
                for first, some in runs(batch.column("text")):
                    for k, found in enumerate(scanned(index.value, some, hashes), first):
                        rows += [(ids[k], item, s, n, got) for i, (got, s, n) in found.items() for item in index.value.ids[i]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        return run

    found = [texts.mapInArrow(scan(sc.broadcast(index)), LEAKS) for index in indices(benchmark)]
    return reduce(DataFrame.unionByName, found) if found else common.empty_like(docs.sparkSession, LEAKS)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents with all their columns in which no window matches an item; each row is judged by its own text."""
    sc = docs.sparkSession.sparkContext
    plain, names = common.renamed(docs)
    text = common.place(names, "text")

    def keep(index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = Hashes()
            for batch in batches:
                good = [not found for _, some in runs(batch.column(text).cast(pa.string())) for found in scanned(index.value, some, hashes)]
                yield batch.filter(pa.array(good, pa.bool_()))

        return run

    for index in indices(benchmark):
        plain = plain.mapInArrow(keep(sc.broadcast(index)), plain.schema)
    return common.restored(plain, names)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
