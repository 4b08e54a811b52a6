"""Bounded samples of labelled documents, and small models fitted to them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, mod: int, held: int, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(doc_id, text, y): at most `per_class` labelled documents of each class, first by a hash of their id.

    Labels are read from the rows only whose fold isn't the held-out one. Of several labels for a document the largest
    counts; rows without id or label are left out. The chosen ids are few by the bound, so they are broadcast. Of several
    texts with one id the one with the least hash counts, so that the result is bounded whatever repeats."""
    ids = common.only(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    ids = ids.where(F.col("doc_id").isNotNull() & F.col("y").isin(*classes) & (common.fold(F.col("doc_id"), mod) != held)).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = None
    for c in classes:
        own = ids.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = own if chosen is None else chosen.unionAll(own)
    texts = common.only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"), F.first("y").alias("y"))
    return one.select("doc_id", "t.text", "y")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last one is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), ridge * len(x) * np.diag([*[1.0] * (x.shape[1] - 1), 1e-6]) / max(1, len(x))
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
