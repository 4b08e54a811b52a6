"""Vectors: similarities within blocks, centred statistics, leader and average-link clustering of small groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .folds import fold

#: Rows of a block that is compared at once.
BLOCK = 512


def similar_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(i, j, similarity): pairs of vectors of one label with cosine similarity of at least `least`, i < j.

    The label is the equality that keeps this from being a cross join; within a label blocks of rows meet block by block,
    so no task holds more than two blocks. Rows without a vector are left out; rows of one id make no pair with each other;
    a null label is a label of its own; vectors of unequal length have no similarity."""
    numbered = vectors.where("embedding is not null").withColumn("block", F.floor((F.row_number().over(Window.partitionBy("label").orderBy("id")) - 1) / BLOCK))
    blocks = numbered.groupBy("label").agg((F.max("block") + 1).alias("n"))
    sent = numbered.join(blocks.select(F.col("label").alias("_label"), "n"), F.col("label").eqNullSafe(F.col("_label"))).select("label", "id", "embedding", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other"))
    meets = sent.select("label", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "id", "embedding")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        out = []
        for _, same in pdf.groupby(pdf["embedding"].map(len)):
            x, y = same[same["block"] == a], same[same["block"] == b]
            if not len(x) or not len(y):
                continue
            unit = [v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (np.stack(x["embedding"]).astype(float), np.stack(y["embedding"]).astype(float))]
            sims = unit[0] @ unit[1].T
            i, j = np.nonzero(sims >= least)
            left, right = x["id"].to_numpy()[i], y["id"].to_numpy()[j]
            keep = left < right if a == b else left != right
            low, high = np.minimum(left, right)[keep], np.maximum(left, right)[keep]
            out.append(pd.DataFrame({"i": low, "j": high, "similarity": sims[i, j][keep]}))
        return pd.concat(out) if out else pd.DataFrame({"i": [], "j": [], "similarity": []}).astype({"i": "int64", "j": "int64"})

    return meets.groupBy("label", "a", "b").applyInPandas(compare, "i long, j long, similarity double")


def label_statistics(vectors: DataFrame) -> DataFrame:
    """(label, k, mean, deviation): per label and dimension."""
    each = vectors.select("label", F.posexplode("embedding").alias("k", "x"))
    return each.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.stddev_pop(F.col("x").cast("double")).alias("deviation"))


def leader_clusters(tracks: DataFrame, least: float) -> DataFrame:
    """(key, id, cluster, person): tracks (key, id, n, embedding), of n sightings each, by persons. The longest track comes
    first, of equals the one with the smallest id; a track joins the group whose weighted mean is most similar to it, of
    equals the latest group, if the cosine reaches `least`, else it opens one. A group is named by its first track, and
    persons are numbered from 1 by sightings, of equals the earlier group first.

    Sequential by definition: a key's tracks are walked in order and only one sum for each group is kept; a key is a
    recording, with as many groups as it has persons. A track without an embedding (null or of another length than the
    first) is a group of its own; a null n counts as 0."""

    def step(groups, less, id_, v):
        if v is None or any(x is None for x in v) or (groups and len(groups[0][1]) != len(v)):
            return groups, (id_,)
        x = np.asarray(v, float)
        x = x / max(np.linalg.norm(x), 1e-300)
        best = max(((float(x @ total) / max(np.linalg.norm(total), 1e-300), k) for k, (_, total) in enumerate(groups)), default=(-2.0, -1))
        if best[0] >= least:
            name, total = groups[best[1]]
            groups[best[1]] = (name, total - less * x)
            return groups, (name,)
        groups.append((id_, -min(less, -1) * x))
        return groups, (id_,)

    ordered = tracks.select("key", "id", (-F.coalesce("n", F.lit(0)).cast("long")).alias("less"), F.col("embedding").cast("array<double>").alias("embedding"))
    placed = fold(ordered, ["key"], ["less", "id"], ["embedding"], "cluster long", list, step).select("key", "id", "cluster", "less")
    sums = placed.groupBy("key", "cluster").agg(F.sum("less").alias("seen"), F.min(F.struct("less", "id")).alias("first"))
    person = F.row_number().over(Window.partitionBy("key").orderBy("seen", "first")).cast("long")
    return placed.join(sums.select("key", "cluster", person.alias("person")), ["key", "cluster"]).select("key", "id", "cluster", "person")


#: Rows of a group that average_link() takes: it holds all their distances.
MOST_ROWS = 4000


def average_link(groups: DataFrame, most_distance: float) -> DataFrame:
    """(key, id, cluster): agglomerative clustering with average links of the rows of each key; merging stops when the nearest
    two clusters are further apart than `most_distance`. A cluster is named by its smallest id.

    A key is a recording and its rows are the recording's pieces. A group of more than MOST_ROWS rows is an error, told
    before any group is gathered; rows without an embedding are clusters of their own."""
    sizes = groups.groupBy("key").agg(F.count("*").alias("n"))
    told = F.when(F.col("n") <= MOST_ROWS, F.col("n")).otherwise(F.raise_error(F.format_string("a group of %d rows", F.col("n"))))
    fit = groups.join(sizes.select(F.col("key").alias("_key"), told.alias("_n")), F.col("key").eqNullSafe(F.col("_key"))).where("_n > 0")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        names, some = pdf["id"].to_numpy().copy(), pdf["embedding"].notna().to_numpy()
        if some.any():
            x = np.stack(pdf["embedding"][some]).astype(float)
            squares = (x**2).sum(1)
            d = np.sqrt(np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0))
            np.fill_diagonal(d, np.inf)
            size, member = np.ones(len(x)), np.arange(len(x))
            while len(x) > 1:
                i, j = divmod(int(np.argmin(d)), len(x))
                if not d[i, j] <= most_distance:
                    break
                i, j = min(i, j), max(i, j)
                row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
                d[i], d[:, i] = row, row
                d[i, i] = np.inf
                d[j], d[:, j] = np.inf, np.inf
                size[i] += size[j]
                member[member == j] = i
            names[some] = names[some][member]
        return pd.DataFrame({"key": pdf["key"], "id": pdf["id"], "cluster": names})

    return fit.select("key", "id", "embedding").groupBy("key").applyInPandas(run, "key long, id long, cluster long")


def distances(vectors: DataFrame, to: str) -> DataFrame:
    """Adds the root mean square distance of `embedding` to another array column."""
    n = F.size("embedding")
    total = F.aggregate(F.zip_with("embedding", to, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.withColumn("rms", F.sqrt(total / n))
