"""Quality by positive-unlabelled learning.

Trusted positives are labelled good and lie outside the held-out fold; unlabelled are all documents outside it. A linear
model over byte statistics minimises the non-negative unbiased risk pi*R+(P) + max(0, R-(U) - pi*R-(P)): no document is taken
for a negative one. With the squared loss (1 - y*g)^2/4 the risk needs no more of a set of documents than the mean and the
second moments of its statistics, so that the unlabelled side is exact over any number of documents: each task adds up its
own moments, and one small matrix reaches the driver. The class prior pi is the share of good ones among the labels outside
the held-out fold. A two-parameter curve then brings the output to probabilities; it alone is fitted to labelled documents
of both classes and changes no order.

Defined cases. A null text is empty; an empty text has all-zero statistics and gets a score like any other; very long texts
are read whole. Without usable labels every score is 0.5. Rows with equal or null ids stay separate rows; of several labels
or texts of a labelled id one counts (see samples.py). Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .samples import labelled, logistic, sigmoid

#: Labelled documents of each class that are learned from, at most (those of the other class for the curve alone).
LABELLED = 8_000
#: Hashed byte pairs, and byte kinds.
PAIRS = 512
KINDS = np.array([0 if b in b"\t\n\r\x0b\x0c " else 1 if 48 <= b < 58 else 2 if 65 <= b < 91 else 3 if 97 <= b < 123 else 4 if b >= 128 else 5 if b < 32 or b == 127 else 6 + (b * 7 + 3) % 34 for b in range(256)])
FIRST_CODE, SECOND_CODE = (np.random.default_rng(k).integers(0, PAIRS, 256) for k in (1, 2))
SHAPES = 9
WIDTH = PAIRS + 40 + SHAPES
#: Sums of moments after each round of adding: every task's go to one of so many, until one is left.
BRANCHES = (64, 8, 1)
#: Of a symmetric matrix the upper half is sent.
UPPER = np.triu_indices(WIDTH)
THRESHOLD = 0.3


def statistics(text: bytes) -> np.ndarray:
    """Square roots of the shares of byte pairs and byte kinds, and how the text repeats itself."""
    out = np.zeros(WIDTH, np.float32)
    if not text:
        return out
    b = np.frombuffer(text, np.uint8)
    out[:PAIRS] = np.bincount(FIRST_CODE[b[:-1]] ^ SECOND_CODE[b[1:]], minlength=PAIRS) / max(1, len(b) - 1)
    out[PAIRS : PAIRS + 40] = np.bincount(KINDS[b], minlength=40)[:40] / len(b)
    np.sqrt(out, out)
    words, lines = text.split(), text.split(b"\n")
    seen = Counter(words)
    out[PAIRS + 40 :] = (
        np.log1p(len(words)) / 10,
        len(seen) / max(1, len(words)),
        max(seen.values(), default=0) / max(1, len(words)),
        len(set(lines)) / len(lines),
        len(zlib.compress(text, 1)) / (len(text) + 50),
        np.log1p(len(b) / max(1, len(words))),
        np.log1p(len(b) / len(lines)) / 10,
        sum(a == c for a, c in zip(words, words[1:], strict=False)) / max(1, len(words)),
        1.0,
    )
    return out


@dataclass
class Model:
    weights: np.ndarray
    constant: float
    middle: np.ndarray
    spread: np.ndarray
    curve: tuple[float, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.middle) / self.spread @ self.weights + self.constant

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] * self.raw(x) + self.curve[1])


@dataclass
class Moments:
    """How many, their mean, and the mean of their products."""

    n: int
    mean: np.ndarray
    product: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        return cls(len(x), x.mean(0), x.T @ x / len(x))

    def standardised(self, middle: np.ndarray, spread: np.ndarray) -> Moments:
        """Those of (x - middle) / spread, with a constant one at the end."""
        shift = np.outer(self.mean, middle)
        product, mean = (self.product - shift - shift.T + np.outer(middle, middle)) / np.outer(spread, spread), (self.mean - middle) / spread
        return Moments(self.n, np.append(mean, 1.0), np.block([[product, mean[:, None]], [mean[None, :], np.ones((1, 1))]]))


def non_negative_pu(positive: Moments, unlabelled: Moments, prior: float, steps: int = 1000, rate: float = 2e-3, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """Weights and constant by Adam on the whole risk, the mean of the steps' second half; where the estimated negative risk
    falls below zero the step goes back along it."""
    w = np.zeros(len(positive.mean))
    w[-1] = 2 * prior - 1
    shrink = np.append(np.full(len(w) - 1, ridge), 0)
    m, v, average = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        u, p = unlabelled.product @ w, positive.product @ w
        negative = (1 + 2 * w @ unlabelled.mean + w @ u) / 4 - prior * (1 + 2 * w @ positive.mean + w @ p) / 4
        of_negative = (unlabelled.mean + u) / 2 - prior * (positive.mean + p) / 2
        of_positive = prior * (p - positive.mean) / 2
        g = (of_positive + of_negative if negative >= 0 else -of_negative) + shrink * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if 2 * t > steps:
            average += w
    average /= steps - steps // 2
    return average[:-1], float(average[-1])


def statistic_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [statistics(t.as_py() or b"").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.binary())], ["y", "x"])


def sum_row(branch: int, n: int, first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"branch": pa.array([branch], pa.int32()), "n": [n], "first": [first.tobytes()], "second": [second[UPPER].tobytes()]})


SUMS = "branch int, n long, first binary, second binary"


def sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of a task's statistics and of their products."""
    n, first, second = 0, np.zeros(WIDTH), np.zeros((WIDTH, WIDTH))
    for batch in batches:
        column = batch.column("text")
        for k in range(0, len(column), 500):
            x = np.stack([statistics(t.as_py() or b"") for t in column[k : k + 500]]).astype(float)
            n, first, second = n + len(x), first + x.sum(0), second + x.T @ x
    if n:
        yield sum_row(TaskContext.get().partitionId() % BRANCHES[0], n, first, second)


def whole_matrix(upper: np.ndarray) -> np.ndarray:
    out = np.zeros((WIDTH, WIDTH))
    out[UPPER] = upper
    return out + np.triu(out, 1).T


def joined_sums(branches: int):
    def run(key, group):  # without hints: Spark tells the kind by the arguments
        n, first, second = 0, np.zeros(WIDTH), np.zeros(len(UPPER[0]))
        for k in range(len(group)):
            n += group["n"][k].as_py()
            first += np.frombuffer(group["first"][k].as_buffer())
            second += np.frombuffer(group["second"][k].as_buffer())
        return pa.Table.from_batches([sum_row(key[0].as_py() % branches, n, first, whole_matrix(second))])

    return run


def moments(docs: DataFrame) -> Moments | None:
    """Those of all texts: summed in each task, then by BRANCHES, so that no task adds up more than a few of the others."""
    sums = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(sum_batches, SUMS)
    for branches in (*BRANCHES[1:], 1):
        sums = sums.groupBy("branch").applyInArrow(joined_sums(branches), SUMS)
    rows = sums.toArrow()  # one row of a fixed size
    if not len(rows):
        return None
    n = rows["n"][0].as_py()
    return Moments(n, np.frombuffer(rows["first"][0].as_buffer()) / n, whole_matrix(np.frombuffer(rows["second"][0].as_buffer())) / n)


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, held: int = 0) -> Model | None:
    known = labelled(docs, labels, "quality", LABELLED, mod, held).select("y", F.col("text").cast("binary").alias("text"))
    rows = known.mapInArrow(statistic_batches, "y int, x binary").toArrow()  # bounded by LABELLED
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(float)
    y = rows.column("y").to_numpy()
    if (y == 1).sum() < 10:
        return None
    unlabelled = moments(common.only(docs, "doc_id", "text").where(common.fold(F.col("doc_id"), mod) != held))
    shares = common.only(labels, "doc_id", "quality").where(F.col("quality").isin(0, 1) & (common.fold(F.col("doc_id"), mod) != held)).agg(F.count("*"), F.sum(F.col("quality").cast("long"))).first()
    prior = min(0.99, max(0.01, shares[1] / shares[0]))
    middle, spread = unlabelled.mean, np.maximum(np.sqrt(np.maximum(0, np.diag(unlabelled.product) - unlabelled.mean**2)), 1e-3)
    weights, constant = non_negative_pu(Moments.of(x[y == 1]).standardised(middle, spread), unlabelled.standardised(middle, spread), prior)
    model = Model(weights, constant, middle, spread, (4.0, 0.0))
    if (y == 0).sum() >= 10:
        c = logistic(model.raw(x)[:, None], y.astype(float), ridge=1e-3)
        drawn = (y == 1).mean()
        model.curve = (max(0.05, float(c[0])), float(c[1] + np.log(prior / (1 - prior)) - np.log(drawn / (1 - drawn))))
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column("text")]
            if model is None:
                found = np.full(len(texts), 0.5)
            else:
                found = np.concatenate([model.score(np.stack([statistics(t) for t in texts[k : k + 500]])) for k in range(0, len(texts), 500)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double")


def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
