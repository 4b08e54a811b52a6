"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches in folded text.

Folding lower-cases, turns homoglyphs and letters with marks into the letters they look like and digits or signs inside
words into the letters they stand for, and everything else between words into one space. Lexicon entries are words or
beginnings of words, with the log-odds of toxic documents that hold them as weights; they are learned from labelled
documents beside a short seed list. Exceptions are words and phrases that hold an entry without being toxic. A document's weight, taken as a sum and
against its length, gives the score through a logistic curve fitted to the labelled documents.

Defined cases. A null or empty text has no match and gets the score of the constant alone, like any text without a match.
Without usable labels the seed list and a fixed curve are used. Rows with equal or null ids stay separate rows. Extra
columns are ignored; very long texts are matched whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .samples import labelled, logistic, sigmoid

#: Words that are insults in general use, and their weight where labels don't say otherwise.
SEED = ("idiot", "idiots", "idiotic", "moron", "morons", "stupid", "stupidity", "imbecile", "loser", "losers", "scum", "scumbag", "trash", "worthless", "pathetic", "disgusting", "clown", "bastard", "bitch", "asshole")
SEED_WEIGHT = 3.0
#: Phrases that hold such a word and are no insult.
EXCEPTIONS = ("trash can", "trash bin", "take out the trash", "clown fish", "stupid question", "sore loser pays", "class clown award")
#: Labelled documents of each class that are learned from, at most.
LEARN_FROM = 12_000
#: Beginnings of words that are counted: from this many letters to that many, and whole words.
SHORTEST, LONGEST = 4, 9
#: Entries need so many toxic documents and so many times the odds. What passes is kept: its number is bounded by LEARN_FROM.
LEAST_DOCS, LEAST_LIFT = 4, 6.0
#: Score from which a document counts as toxic.
THRESHOLD = 0.3

LOOKALIKES = dict(zip("аеорсухіјѕԁһոսνωοαρτικβ", "aeopcyxijsdhnuvwoaptikb", strict=True)) | {"ı": "i", "ł": "l", "ø": "o", "ⅼ": "l", "ⅰ": "i", "ɡ": "g", "ʏ": "y"}
LOOKALIKES |= {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {chr(0x1D41A + 26 * 2 * v + k): chr(97 + k) for v in range(13) for k in range(26)}
#: Latin letters with marks count as the plain letter that they decompose to.
LOOKALIKES |= {chr(c): unicodedata.normalize("NFKD", chr(c))[0] for c in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(c))[0].isascii() and chr(c).islower()}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
TO_LETTERS = str.maketrans(LOOKALIKES)
#: Digits and signs between letters, before the first letter of a word and after its last; '!' after it ends a sentence.
SIGNS = re.compile(r"(?<=[^\W\d_])(?:[0134578@$!]+(?=[^\W\d_])|[0134578@$]+(?!\w))|(?<!\w)[0134578@$]+(?=[^\W\d_])|(?<![\w!])!(?=[^\W\d_])")
TO_DIGITS = str.maketrans(DIGITS)
INVISIBLE = re.compile("[\u0300-\u036f­​-‏⁠﻿]+")
BETWEEN = re.compile(r"[\W\d_]+")


def folded(text: str) -> str:
    """Words in folded letters, each with a space before and after."""
    text = text.lower()
    if not text.isascii():
        text = INVISIBLE.sub("", text).translate(TO_LETTERS)
    text = SIGNS.sub(lambda m: m[0].translate(TO_DIGITS), text)
    return f" {BETWEEN.sub(' ', text).strip()} "


def entries_of(text: str) -> set[str]:
    """The possible lexicon entries of a text: ' word ' for whole words, ' beg' for beginnings."""
    out = set()
    for word in set(folded(text).split()):
        out.add(f" {word} ")
        out.update(f" {word[:k]}" for k in range(SHORTEST, min(LONGEST, len(word)) + 1))
    return out


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each entry, summed over a task."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            counts.update(entries_of(text.as_py() or ""))
        if len(counts) > 2_000_000:
            yield pa.RecordBatch.from_pydict({"entry": list(counts), "n": list(counts.values())})
            counts.clear()
    yield pa.RecordBatch.from_pydict({"entry": pa.array(counts, pa.string()), "n": pa.array(counts.values(), pa.int64())})


def chosen_entries(good: dict[str, tuple[int, float]], shared: list[str]) -> tuple[dict[str, float], list[str]]:
    """Entries with weights and exceptions: of the shared words those with a kept beginning. good: entry -> (toxic documents, lift).

    A longer entry goes where a shorter one of nearly its weight, or of the same documents, is kept."""
    kept: dict[str, float] = {}
    for e in sorted(good, key=lambda e: (len(e), e)):
        n, lift = good[e]
        stems = [e[:k] for k in range(SHORTEST + 1, len(e)) if e[:k] in kept]
        if not any(kept[s] >= lift - 1.0 or n == good[s][0] for s in stems):
            kept[e] = lift
    return kept, sorted(e for e in shared if any(e[:k] in kept for k in range(SHORTEST + 1, len(e))))


def automaton(model: Model) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for entry, weight in model.weights.items():
        a.add_word(entry, (len(entry), weight))
    for phrase in model.exceptions:
        a.add_word(phrase, (len(phrase), None))
    if len(a):
        a.make_automaton()
    return a


def hits(a: ahocorasick.Automaton, text: str) -> tuple[float, int]:
    """The weight of the matched words, each counted by its heaviest entry, without those in an exception; words."""
    text = folded(text)
    words = text.count(" ") - 1 if len(text) > 2 else 0
    if not len(a):
        return 0.0, words
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in a.iter(text):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        # of the exceptions that begin at or before a hit, does the one that reaches furthest end after it
        spared.sort()
        starts, reach = [x for x, _ in spared], list(accumulate((y for _, y in spared), max))
        best = {s: w for s, w in best.items() if not ((k := bisect_right(starts, s)) and reach[k - 1] > s)}
    return sum(best.values()), words


def features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log1p(weight), np.log1p(100 * weight / (words + 20))], axis=1)


def hit_batches(model: Model, more: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(model)
        curve = np.array(model.curve)
        for batch in batches:
            found = [hits(a, text.as_py() or "") for text in batch.column("text")]
            weight, words = (np.array(x, float) for x in zip(*found, strict=True)) if found else (np.zeros(0), np.zeros(0))
            score = sigmoid(features(weight, words) @ curve[:2] + curve[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in more], pa.array(weight), pa.array(words.astype(np.int64)), pa.array(score)], [*more, "weight", "n_words", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, mod: int = 4, held: int = 2) -> Model:
    """Lexicon, exceptions and curve from at most LEARN_FROM labelled documents of each class."""
    seed = {f" {w} ": SEED_WEIGHT for w in SEED}
    plain = Model(seed, tuple(f" {p} " for p in EXCEPTIONS), (1.0, 0.5, -3.5))
    sample = common.stored(labelled(docs, labels, "toxic", LEARN_FROM, mod, held), "toxicity-sample")
    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 2 * LEAST_DOCS:
        return plain

    def counted(y: int) -> DataFrame:
        return sample.where(F.col("y") == y).select("text").mapInArrow(count_batches, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))

    toxic = common.stored(counted(1).where(F.col("n") >= LEAST_DOCS), "toxicity-entries")
    ratio = lambda c, y: F.log((F.coalesce(c, F.lit(0)) + 0.5) / (sizes[y] + 1))
    judged = toxic.join(counted(0).withColumnRenamed("n", "clean"), "entry", "left").withColumn("lift", ratio(F.col("n"), 1) - ratio(F.col("clean"), 0))
    judged = common.stored(judged, "toxicity-lifts")
    # of beginnings that the same toxic documents hold the longest stays, so that 'tras' doesn't stand for 'trash'
    longer = toxic.select(F.expr("left(entry, length(entry) - 1)").alias("entry"), "n")
    good = judged.where(F.col("lift") >= float(np.log(LEAST_LIFT))).join(longer, ["entry", "n"], "left_anti")
    shared = judged.where(F.col("entry").endswith(" ") & (F.col("clean") >= LEAST_DOCS) & (F.col("lift") < float(np.log(2))))
    # both bounded by what LEARN_FROM documents hold
    weights, spared = chosen_entries({r["entry"]: (r["n"], r["lift"]) for r in good.select("entry", "n", "lift").collect()}, [r["entry"] for r in shared.select("entry").collect()])
    # a seed word keeps its weight only where the labels haven't seen enough of it to tell
    told = {r["entry"] for r in toxic.where(F.col("entry").isin(*seed)).collect()}
    model = Model({e: w for e, w in seed.items() if e not in told} | weights, plain.exceptions + tuple(spared), plain.curve)
    seen = sample.select("y", "text").mapInArrow(hit_batches(model, ("y",)), "y int, weight double, n_words long, score double").toArrow()  # bounded by LEARN_FROM
    prior = labels_share(labels, mod, held)
    w = logistic(features(seen.column("weight").to_numpy(), seen.column("n_words").to_numpy().astype(float)), seen.column("y").to_numpy().astype(float), ridge=1.0)
    # the sample holds as many of each class as the bound allows; the constant goes back to the share among all labels
    drawn = sizes[1] / (sizes[0] + sizes[1])
    model.curve = (float(w[0]), float(w[1]), float(w[2] + np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))))
    return model


def labels_share(labels: DataFrame, mod: int, held: int) -> float:
    """The share of toxic ones among all labels outside the held-out fold, kept off 0 and 1."""
    rows = common.only(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (common.fold(F.col("doc_id"), mod) != held))
    n, s = rows.agg(F.count("*"), F.sum(F.col("toxic").cast("long"))).first()
    return ((s or 0) + 1) / (n + 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, weight, n_words, score) of each document."""
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(hit_batches(model, ("doc_id",)), "doc_id long, weight double, n_words long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with all their columns whose score is below the threshold; each row is judged by its own text."""
    plain, names = common.renamed(docs)
    text = common.place(names, "text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, curve = automaton(model), np.array(model.curve)
        for batch in batches:
            found = [hits(a, str(t.as_py() or "")) for t in batch.column(text)]
            if found:
                weight, words = (np.array(x, float) for x in zip(*found, strict=True))
                yield batch.filter(pa.array(sigmoid(features(weight, words) @ curve[:2] + curve[2]) < threshold))

    return common.restored(plain.mapInArrow(keep, plain.schema), names)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "n_words")
