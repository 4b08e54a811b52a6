"""Sequence alignment with the standard library's matcher, in Arrow batches, one pair of texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def neighbours(df: DataFrame, order: str, text: str = "text", words_only: bool = True) -> DataFrame:
    """(key, i, a, b): each row's words with those of the next row of its key; a null text has no words."""
    following = Window.partitionBy("key").orderBy(order)
    split = lambda c: F.coalesce(F.array_remove(F.split(F.trim(c), r"\s+"), ""), F.array().cast("array<string>"))
    both = df.select("key", F.col(order).alias("i"), F.col(text).alias("_a"), F.lead(text).over(following).alias("_b"), F.lead(F.lit(True)).over(following).alias("_more"))
    return both.where("_more").select("key", "i", split(F.col("_a")).alias("a"), split(F.col("_b")).alias("b"))


def some(words) -> list:
    """A list of words, null as none, and null words as empty ones."""
    return [] if words is None else ["" if w is None else w for w in words]


def opcodes(pairs: DataFrame) -> DataFrame:
    """(key, i, n, tag, i1, i2, j1, j2): how to turn a into b."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = [(k, i, n, *op) for k, i, a, b in pdf[["key", "i", "a", "b"]].itertuples(index=False) for n, op in enumerate(SequenceMatcher(None, some(a), some(b)).get_opcodes())]
            yield pd.DataFrame(rows, columns=["key", "i", "n", "tag", "i1", "i2", "j1", "j2"])

    return pairs.mapInPandas(run, "key long, i long, n int, tag string, i1 int, i2 int, j1 int, j2 int")


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matches over the total length."""
    return pd.Series([SequenceMatcher(None, some(x), some(y)).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def word_key(w: str) -> str:
    """Lower case without anything but letters, digits and underscores."""
    return re.sub(r"[^\w]", "", w.lower())


def realigned(words: list[str], corrected: list[str]) -> list[str]:
    """Corrected words put into the slots of the original ones: equal ones in place, replaced ones spread in proportion,
    inserted ones with the slot before (the first slot at the start). Words are compared without case and punctuation."""
    slots: list[list[str]] = [[] for _ in words]
    if not slots:
        return []
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [word_key(w) for w in words], [word_key(w) for w in corrected]).get_opcodes():
        if tag == "insert":
            slots[max(0, i1 - 1)] += corrected[j1:j2]
            continue
        for n, j in enumerate(range(j1, j2)):
            slots[i1 + n * (i2 - i1) // (j2 - j1)].append(corrected[j])
    return [" ".join(s) for s in slots]


@F.pandas_udf(T.ArrayType(T.StringType()))
def realign(words: pd.Series, corrected: pd.Series) -> pd.Series:
    return pd.Series([realigned(some(a), some(b)) for a, b in zip(words, corrected, strict=True)])


def merged_words(first: list[dict], second: list[str], suspect=lambda w: w["p"] < 0.5) -> list[dict]:
    """A transcript's words {w, p} checked against a second one of the same speech: words both have are confirmed (v 0); a
    suspect run that the second gives with as many words is replaced, the old word kept in alt (v 1); another suspect run
    gets the second's words as a proposal on its first word (alt, and altn words it would replace). A null word is an empty
    one, a null confidence is none."""
    key = lambda w: "".join(c for c in w.lower() if c.isalnum())
    out = [dict(w) for w in first]
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, [key(w["w"]) for w in first], [key(w) for w in second], autojunk=False).get_opcodes():
        if tag == "equal":
            for k in range(i1, i2):
                out[k]["v"] = 0
        elif tag == "replace" and any(suspect(first[k]) for k in range(i1, i2)):
            if i2 - i1 == j2 - j1:
                for k in range(i1, i2):
                    out[k].update(alt=first[k]["w"], w=second[j1 + k - i1], v=1)
            else:
                out[i1].update(alt=" ".join(second[j1:j2]), altn=i2 - i1)
    return out


MERGED = pa.list_(pa.struct([("w", pa.string()), ("p", pa.float64()), ("v", pa.int32()), ("alt", pa.string()), ("altn", pa.int32())]))
#: Words of pairs that are Python objects at one time.
MOST_WORDS = 20_000


def merge_slices(first: pa.Array, second: pa.Array, most: int = MOST_WORDS) -> pa.Array:
    """merged_words() of each pair. Only pairs of `most` words together, or a single pair, are Python objects at a time."""
    blank, done, a = {"v": None, "alt": None, "altn": None}, [], 0
    words = np.cumsum(sum(x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (first, second)))
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(words, (words[a - 1] if a else 0) + most, "right")))
        rows = [[blank | w for w in merged_words([{"w": (x or blank).get("w") or "", "p": (x or blank).get("p") or 0.0} for x in (one or [])], some(other))] for one, other in zip(first[a:b].to_pylist(), second[a:b].to_pylist(), strict=True)]
        done.append(pa.array(rows, MERGED))
        a = b
    return pa.concat_arrays(done) if done else pa.array([], MERGED)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("w", T.StringType()), T.StructField("p", T.DoubleType()), T.StructField("v", T.IntegerType()), T.StructField("alt", T.StringType()), T.StructField("altn", T.IntegerType())])))
def merge_transcripts(first: pa.Array, second: pa.Array) -> pa.Array:
    """merged_words() of array<struct<w, p>> and array<string>."""
    return merge_slices(first, second)
