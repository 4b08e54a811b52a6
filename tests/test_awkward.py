"""Nulls, uneven lists, ties and empty tables in operators that once failed on them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, folds, series, timeline, tracks, vectors


def test_alignment_with_nulls(spark):
    turns = spark.createDataFrame([(1, 1, None), (1, 2, "a b"), (1, 3, "a c"), (1, 4, None), (2, 1, "x"), (None, 1, "q"), (None, 2, "q")], "key long, i long, text string")
    pairs = align.neighbours(turns, "i")
    assert sorted((str(r["key"]), r["i"], r["a"], r["b"]) for r in pairs.collect()) == [("1", 1, [], ["a", "b"]), ("1", 2, ["a", "b"], ["a", "c"]), ("1", 3, ["a", "c"], []), ("None", 1, ["q"], ["q"])]
    raw = spark.createDataFrame([(1, 1, None, ["a"]), (1, 2, ["a", None], None)], "key long, i long, a array<string>, b array<string>")
    assert [(r["i"], r["tag"]) for r in align.opcodes(raw).orderBy("i").collect()] == [(1, "insert"), (2, "delete")]
    assert [r[0] for r in raw.orderBy("i").select(align.ratio("a", "b")).collect()] == [0.0, 0.0]
    assert [r[0] for r in raw.orderBy("i").select(align.realign("a", "b")).collect()] == [[], ["", ""]]
    first = spark.createDataFrame([([(None, 0.9), ("b", None)], ["a", "c"]), (None, ["a"])], "a array<struct<w:string,p:double>>, b array<string>")
    got = [r[0] for r in first.select(align.merge_transcripts("a", "b")).collect()]
    assert [(w["w"], w["v"]) for w in got[0]] == [("a", 1), ("c", 1)] and got[1] == []


def test_captions_with_short_lists(spark):
    spoken = spark.createDataFrame([(1, ["a", "b", None], [0], None, None), (2, None, None, None, None), (3, ["", "x"], [1, 2], [None, 5], [1])], "key long, words array<string>, start array<long>, end array<long>, moment array<long>")
    assert [(r["key"], r["n"], r["text"]) for r in timeline.captions(spoken).orderBy("key").collect()] == [(1, 2, "a b"), (3, 1, "x")]


def test_vectors_of_unequal_length_and_null_labels(spark):
    rows = [(1, None, [1.0, 0.0]), (2, None, [2.0, 0.0]), (3, "a", [1.0]), (4, "a", [1.0, 0.0]), (5, "a", [3.0, 0.1]), (6, "a", None), (7, "a", [2.0])]
    got = vectors.similar_pairs(spark.createDataFrame(rows, "id long, label string, embedding array<double>"), 0.9)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == [(1, 2), (3, 7), (4, 5)]


def test_turns_and_lines_with_nulls(spark):
    runs = spark.createDataFrame([(1, 1, "a", 0, 5), (1, 2, "b", 10, None), (1, 3, "c", 20, 9)], "key long, run long, spk string, s long, n long")
    assert [(r["turn"], r["spk"]) for r in folds.held_turns(runs, 3).orderBy("turn").collect()] == [(1, "a"), (2, "c")]
    lines = spark.createDataFrame([(1, [3.0, 1.0, 2.0], 2), (2, None, 2), (3, [1.0, None, 2.0], None)], "id long, w array<double>, n int")
    assert [r[0] for r in lines.orderBy("id").select(tracks.line_layout("w", "n")).collect()] == [[1], [], []]


def test_strongest_of_each_key(spark):
    rows = [(k, t * 100, t, float(t % 4)) for k in (1, 2, None) for t in range(6)]
    got = series.strongest(spark.createDataFrame(rows, "key long, t long, id long, strength double"), 10, 2)
    assert sorted((str(r["key"]), r["id"]) for r in got.collect()) == sorted((k, i) for k in ("1", "2", "None") for i in (2, 3))


@pytest.mark.parametrize("make", [lambda s: align.opcodes(align.neighbours(s.createDataFrame([], "key long, i long, text string"), "i")), lambda s: vectors.similar_pairs(s.createDataFrame([], "id long, label string, embedding array<double>"), 0.5), lambda s: folds.held_turns(s.createDataFrame([], "key long, run long, spk string, s long, n long"), 2)])
def test_empty(spark, make):
    assert make(spark).select(F.lit(1)).count() == 0
