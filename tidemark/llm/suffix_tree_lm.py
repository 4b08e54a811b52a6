"""Language-model scores from a probabilistic suffix tree over the bytes of words.

The model's symbols are bytes; a text is its words with one space after each but the last, then an end. That makes the
probability of the bytes one of the token sequence. Contexts of up to DEPTH symbols are counted over all training texts; a
context stays in the tree if its next-symbol distribution diverges from that of its longest proper suffix by more than a
penalty for its parameters (log-likelihood ratio against LEAST_GAIN for each). Distributions are smoothed
towards the suffix's by the number of distinct successors, down to a uniform one over all bytes. The kept contexts, closed
under their parts, are the states of an automaton that always sits at the longest kept suffix of what it has read. The
MOST_STATES most frequent states go to every task; as no context is more frequent than its parts, they are an automaton of
their own. Where a text goes on into a state outside it, its grams are joined to the table of the other states by a
shuffle, so any number of kept contexts is exact.

The base score needs the count of every word. Counts of the HEAD most frequent words go to every task; the other words of
each text are joined to the table of counts by a shuffle, so any number of distinct words is exact.

Defined cases. A null text is empty; an empty text has one token, its end. Without training texts N and V are 0. Rows with
equal or null ids stay separate rows; a null id falls into the fold of the empty text. Extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, END = 5, 0x0A
#: What a context must gain in log-likelihood for each distinct next symbol to stay (under chance: a half).
LEAST_GAIN = 1.0
#: States and words whose counts every task holds, at most; all others are in tables.
MOST_STATES, HEAD = 1 << 16, 1 << 18
#: Symbols scored one after another in a lane; many lanes go side by side.
LANE = 512
#: Distinct words or contexts that a task holds before it sends their counts on; symbols counted and scored at a time.
MOST_HELD, SYMBOLS_AT_ONCE, SCORED_AT_ONCE = 500_000, 2 << 20, 1 << 19
PAD = bytes([END]) * DEPTH


def words_of(text: bytes) -> list[bytes]:
    """Runs of what isn't ASCII white space, after lower-casing A-Z."""
    return text.lower().split()


def stream_of(words: list[bytes]) -> bytes:
    return PAD + b" ".join(words) + bytes([END])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column("text"):
            counts.update(words_of(text.as_py() or b""))
        if len(counts) > MOST_HELD:
            yield out()
            counts.clear()
    yield out()


def grams(stream: np.ndarray) -> np.ndarray:
    """DEPTH symbols and the next one in a long, the next one lowest; not where the next one only pads."""
    x = stream.astype(np.int64)
    key = np.zeros(max(0, len(x) - DEPTH), np.int64)
    for k in range(DEPTH + 1):
        key = key << 8 | x[k : len(x) - DEPTH + k]
    return key


def added(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if a is None:
        return b
    keys, at = np.unique(np.concatenate((a[0], b[0])), return_inverse=True)
    return keys, np.bincount(at, np.concatenate((a[1], b[1]))).astype(np.int64)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[np.ndarray, np.ndarray] | None = None
    parts: list[bytes] = []
    size = 0

    def taken() -> tuple[np.ndarray, np.ndarray]:
        stream = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        real = np.ones(len(stream), bool)
        for k in range(DEPTH):
            real[np.concatenate(([0], ends[:-1])) + k] = False  # what pads a text's start is no next symbol
        return np.unique(grams(stream)[real[DEPTH:]], return_counts=True)

    for batch in batches:
        for text in batch.column("text"):
            parts.append(stream_of(words_of(text.as_py() or b"")))
            size += len(parts[-1])
            if size > SYMBOLS_AT_ONCE:
                held, parts, size = added(held, taken()), [], 0
                if len(held[0]) > 2 * MOST_HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["gram", "n"])
                    held = None
    if parts:
        held = added(held, taken())
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], ["gram", "n"])


@dataclass
class Tree:
    """The automaton: column_of[byte], and for state × column the next state, the log10 probability of the symbol, and
    whether the symbol before the state's own makes it a state outside the automaton; sizes[state]."""

    column_of: np.ndarray
    following: np.ndarray
    logs: np.ndarray
    start: int
    sizes: np.ndarray
    beyond: np.ndarray

    def symbol_logs(self, stream: np.ndarray) -> np.ndarray:
        return self.walked(stream)[0]

    def walked(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each symbol of the stream after those before it, and the state it was read in.

        A state depends on the last DEPTH symbols alone, so the stream is cut into lanes that each read DEPTH symbols of
        the one before and then go forward side by side."""
        n, width = len(stream), self.following.shape[1]
        lanes = -(-n // LANE)
        columns = np.full(DEPTH + lanes * LANE, self.column_of[END], np.int64)
        columns[DEPTH : DEPTH + n] = self.column_of[stream]
        laid = np.lib.stride_tricks.sliding_window_view(columns, LANE + DEPTH)[::LANE].T.copy()
        state = np.zeros(lanes, np.int64)
        out, states = np.empty((LANE, lanes), np.float32), np.empty((LANE, lanes), np.int32)
        following, logs = self.following.ravel(), self.logs.ravel()
        for k in range(LANE + DEPTH):
            at = state * width + laid[k]
            if k >= DEPTH:
                out[k - DEPTH], states[k - DEPTH] = logs[at], state
            state = following[at].astype(np.int64)
        return out.T.ravel()[:n], states.T.ravel()[:n]

    def outside(self, stream: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Places of the stream, from DEPTH on, whose longest kept context isn't in the automaton."""
        some, out = self.beyond.any(1), [np.zeros(0, np.int64)]
        for first in range(DEPTH, len(stream), 1 << 17):
            at = first + np.flatnonzero(some[states[first : first + (1 << 17)]])
            out.append(at[self.beyond[states[at], self.column_of[stream[at - 1 - self.sizes[states[at]]]]]])
        return np.concatenate(out)


def contexts(counts: DataFrame) -> DataFrame:
    """(k, key, n): counts of each context of k symbols with each next one, for all k up to DEPTH."""
    masks = F.array(*[F.struct(F.lit(k).alias("k"), F.lit((1 << 8 * (k + 1)) - 1).alias("mask")) for k in range(DEPTH + 1)])
    return counts.select(F.explode(masks).alias("m"), "gram", "n").groupBy(F.col("m.k").alias("k"), F.col("gram").bitwiseAND(F.col("m.mask")).alias("key")).agg(F.sum("n").alias("n"))


def learned(counts: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree from (gram, n) over all training texts, and the states it has no place for: (k, context, total, types, nexts)."""
    spark = counts.sparkSession
    per = common.stored(contexts(counts), "lm-contexts")
    total = per.where("k = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return arranged(np.zeros(1, np.int64), np.zeros(1, np.int64), *[np.zeros(0, np.int64)] * 3), common.empty_like(spark, STATES)
    of = per.groupBy("k", F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    own = per.select("k", "key", "n", F.shiftright("key", 8).alias("context"))
    # the suffix's count of the same next symbol: the same key without its first context symbol
    shorter = per.select((F.col("k") + 1).alias("k"), F.col("key").alias("short"), F.col("n").alias("short_n"))
    both = own.where("k > 0").withColumn("short", F.expr("key & (shiftleft(1L, 8 * k) - 1)")).join(shorter, ["k", "short"])
    sums = of.select((F.col("k") + 1).alias("k"), F.col("context").alias("short_context"), F.col("total").alias("short_total"))
    gains = both.groupBy("k", "context").agg(F.sum(F.col("n") * (F.log("n") - F.log("short_n"))).alias("part"))
    tested = gains.join(of, ["k", "context"]).withColumn("short_context", F.expr("context & (shiftleft(1L, 8 * (k - 1)) - 1)")).join(sums, ["k", "short_context"])
    gain = F.col("part") + F.col("total") * (F.log("short_total") - F.log("total"))
    kept = tested.select("k", "context", (gain - F.lit(LEAST_GAIN) * F.col("types")).alias("gain")).where("gain > 0")
    ends = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b - a).alias("size")) for a in range(DEPTH) for b in range(a + 1, DEPTH + 1)])
    cut = kept.select("k", "context", F.explode(ends).alias("e")).where("e.a + e.size <= k")
    parts = cut.select(F.col("e.size").alias("k"), F.expr("shiftright(context, 8 * e.a) & (shiftleft(1L, 8 * e.size) - 1)").alias("context")).distinct()
    root = spark.range(1).select(F.lit(0).alias("k"), F.lit(0).cast("long").alias("context"))
    states = common.stored(of.join(parts.unionAll(root), ["k", "context"]), "lm-states")
    # a part is at least as frequent and shorter, so it comes before what it is a part of
    head = states.orderBy(F.desc("total"), "k", "context").limit(MOST_STATES).toArrow()
    last = {c: head.column(c)[-1].as_py() for c in ("total", "k", "context")}
    at = np.lexsort((head.column("context").to_numpy(), head.column("k").to_numpy()))
    k, context = (head.column(c).to_numpy().astype(np.int64)[at] for c in ("k", "context"))
    chosen = F.broadcast(spark.createDataFrame(pa.table({"k": pa.array(k, pa.int32()), "context": context, "state": np.arange(len(k))})))  # MOST_STATES rows at most
    found = own.join(chosen, ["k", "context"]).select("state", F.col("key").bitwiseAND(255).alias("next"), "n").toArrow()
    later = (F.col("total") < last["total"]) | (F.col("total") == last["total"]) & ((F.col("k") > last["k"]) | (F.col("k") == last["k"]) & (F.col("context") > last["context"]))
    more = states.where(later)
    # states outside that are one symbol longer than a state inside: at most one for each of these and each byte
    longer = more.select((F.col("k") - 1).alias("k"), F.expr("context & (shiftleft(1L, 8 * (k - 1)) - 1)").alias("context"), F.expr("shiftright(context, 8 * (k - 1)) & 255").alias("before"))
    edge = longer.join(chosen, ["k", "context"]).select("state", "before").toArrow()
    nexts = own.join(more, ["k", "context"]).groupBy("k", "context").agg(F.first("total").alias("total"), F.first("types").alias("types"), F.collect_list(F.struct(F.col("key").bitwiseAND(255).cast("int").alias("symbol"), "n")).alias("nexts"))
    tree = arranged(k, context, *[found.column(c).to_numpy().astype(np.int64) for c in ("state", "next", "n")])
    tree.beyond[edge.column("state").to_numpy(), tree.column_of[edge.column("before").to_numpy()]] = True
    return tree, nexts


def grown(counts: DataFrame) -> Tree:
    """The tree alone."""
    return learned(counts)[0]


def arranged(k: np.ndarray, context: np.ndarray, state: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> Tree:
    """The automaton of states given shortest first, with counts of symbols after them."""
    used = np.unique(np.append(symbol, [END, 0x20]))
    column_of = np.full(256, len(used), np.int64)  # bytes never seen share the last column, each with its own probability
    column_of[used] = np.arange(len(used))
    width = len(used) + 1
    counts = np.zeros((len(k), width))
    np.add.at(counts, (state, column_of[symbol]), n)
    total, types = counts.sum(1), (counts > 0).sum(1)
    at = {s: i for i, s in enumerate(zip(k.tolist(), context.tolist(), strict=True))}
    p = np.empty((len(k), width))
    following = np.zeros((len(k), width), np.int32)
    weight = max(1, types[0])
    p[0] = (counts[0] + weight / 256) / (total[0] + weight)
    for length in range(DEPTH + 1):
        own = np.flatnonzero(k == length)
        if not len(own):
            break
        if length:
            short = np.array([at[length - 1, c & (1 << 8 * (length - 1)) - 1] for c in context[own].tolist()])
            t = np.maximum(types[own], 1)[:, None]
            p[own] = (counts[own] + t * p[short]) / (total[own][:, None] + t)
            following[own] = following[short]
        longer = np.flatnonzero(k == length + 1)
        if len(longer):
            before = np.array([at[length, c >> 8] for c in context[longer].tolist()])
            following[before, column_of[context[longer] & 255]] = longer
    start = 0
    for _ in range(DEPTH):
        start = following[start, column_of[END]]
    return Tree(column_of, following, np.log10(p).astype(np.float32), int(start), k.astype(np.int64), np.zeros((len(k), width), bool))


def inside(tree):
    """(gram, base, size): the probability that the automaton gives the gram's last symbol, and the size of its state there.
    tree: a broadcast handle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tree.value
        for batch in batches:
            gram = batch.column("gram").to_numpy()
            state = np.zeros(len(gram), np.int64)
            for k in range(DEPTH, 0, -1):
                state = model.following[state, model.column_of[gram >> 8 * k & 255]]
            base = 10.0 ** model.logs[state, model.column_of[gram & 255]].astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("gram"), pa.array(base), pa.array(model.sizes[state].astype(np.int32))], ["gram", "base", "size"])

    return run


def outside_logs(grams: DataFrame, tree, states: DataFrame) -> DataFrame:
    """(gram, log): log10 probability of each gram's last symbol, from the automaton and the states outside it."""
    known = grams.mapInArrow(inside(tree), "gram long, base double, size int")
    longer = known.select("gram", "base", F.explode(F.sequence(F.col("size") + 1, F.lit(DEPTH))).alias("k")).withColumn("context", F.expr("shiftright(gram, 8) & (shiftleft(1L, 8 * k) - 1)"))
    symbol = F.col("gram").bitwiseAND(255)
    n = F.aggregate(F.filter("nexts", lambda x: x["symbol"] == symbol), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    steps = longer.join(states, ["k", "context"]).select("gram", "base", F.struct("k", n.alias("n"), "total", "types").alias("step"))
    chains = steps.groupBy("gram").agg(F.first("base").alias("base"), F.sort_array(F.collect_list("step")).alias("steps"))
    return chains.select("gram", F.log10(F.aggregate("steps", F.col("base"), lambda p, x: (x["n"] + x["types"] * p) / (x["total"] + x["types"]))).alias("log"))


STATES = "k int, context long, total long, types long, nexts array<struct<symbol:int,n:long>>"
SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:long>>, outside array<long>"


def score_batches(tree, head, total: int, distinct: int, ends: int):
    """tree, head: broadcast handles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, model = head.value, tree.value
        norm = np.log10(total + 0.5 * (distinct + 1))
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            column, at = batch.column("text"), 0
            while at < len(column):
                out: list[list] = [[], [], [], [], []]
                first, words, streams, size = at, [], [], 0
                while at < len(column) and size < SCORED_AT_ONCE:
                    words.append(words_of(column[at].as_py() or b""))
                    streams.append(stream_of(words[-1]))
                    size += len(streams[-1])
                    at += 1
                stream = np.frombuffer(b"".join(streams), np.uint8)
                logs, states = model.walked(stream)
                logs = logs.astype(np.float64)
                ends_at = np.cumsum([len(s) for s in streams])
                far = model.outside(stream, states)
                far = far[far - (ends_at - [len(s) for s in streams])[np.searchsorted(ends_at, far, "right")] >= DEPTH]  # no padding
                logs[far] = 0.0
                far_grams = np.zeros(len(far), np.int64)
                for k in range(DEPTH + 1):
                    far_grams = far_grams << 8 | stream[far - DEPTH + k]
                outside = pa.ListArray.from_arrays(np.append(0, np.searchsorted(far, ends_at)).astype(np.int32), far_grams)
                del states, far, far_grams
                before = np.concatenate(([0.0], np.cumsum(logs)))
                score = before[ends_at] - before[ends_at - [len(s) - DEPTH for s in streams]]
                for own, value in zip(words, score.tolist(), strict=True):
                    c = np.fromiter(map(counts.get, own, repeat(0)), np.int64, len(own))
                    known = int((c > 0).sum())
                    base = float(np.log10(c + 0.5).sum() + np.log10(ends + 0.5)) - (len(own) + 1) * norm
                    rare = Counter(w for w, x in zip(own, c.tolist(), strict=True) if not x) if known < len(own) else {}
                    for column_out, x in zip(out, (len(own) + 1, known + (ends > 0), base, value, [{"word": w, "n": n} for w, n in rare.items()]), strict=True):
                        column_out.append(x)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind)
                done = [batch.column(c).slice(first, at - first) for c in ("row", "doc_id")]
                yield pa.RecordBatch.from_arrays([*done, *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)], outside], ["row", "doc_id", "n_tokens", "n_known", "base", "score", "tail", "outside"])

    return run


def score(docs: DataFrame, mod: int = 5, held: int = 1) -> DataFrame:
    """Base and model scores of each document, learned from those outside the held-out fold."""
    spark = docs.sparkSession
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    training = texts.where(common.fold(F.col("doc_id"), mod) != held)
    ends = training.count()
    counts = common.stored(training.select("text").mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = total + ends, distinct + (ends > 0)
    tree, states = learned(common.stored(training.select("text").mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "lm-grams"))
    # the head: words from a count up, the lowest from which there are no more than HEAD
    least, words = None, 0
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        words += row["words"]
        if words > HEAD:
            break
        least = row["n"]
    common_words = counts.where(F.lit(least is not None) & (F.col("n") >= F.lit(least or 0))).toArrow()
    head = dict(zip(common_words.column("word").to_pylist(), common_words.column("n").to_pylist(), strict=True))
    sc = spark.sparkContext
    tree = sc.broadcast(tree)
    run = score_batches(tree, sc.broadcast(head), total, distinct, ends)
    scored = common.stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, SCORED), "lm-scored")
    # so far a word outside the head counts as unknown; what it adds if it is known comes from the table of counts
    rare = scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times"))
    more = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.log10(F.lit(0.5)))).alias("base_more"), F.sum("times").alias("known_more"))
    grams_outside = scored.select("row", F.explode("outside").alias("gram"))
    logs = outside_logs(grams_outside.select("gram").distinct(), tree, states)
    score_more = grams_outside.join(logs, "gram").groupBy("row").agg(F.sum("log").alias("score_more"))
    out = scored.drop("tail", "outside").join(more, "row", "left").join(score_more, "row", "left")
    return out.select(
        "doc_id",
        (common.fold(F.col("doc_id"), mod) == held).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("score_more", F.lit(0.0))).alias("score"),
    )


def op9_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
