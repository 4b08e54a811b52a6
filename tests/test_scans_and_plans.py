"""Blocked scans against numpy whatever the block, plans against all pairs, marked words, and the table of measurements."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import cost, highlights, scan
from tidemark.sources import measures, work


def signal(spark, n=500, keys=(1,)):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(k, i, float(rng.integers(-50, 50))) for k in keys for i in range(n)], "key long, i long, x double").repartition(4)


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_running_is_the_same_for_every_block(spark, block):
    df = signal(spark, keys=(1, None)).withColumn("x", F.when(F.col("i") % 3 > 0, F.col("x")))
    got = scan.running(df, ["key"], ["i"], F.floor(F.col("i") / block), sums={"total": "x"}, maxima={"most": "x"}, lasts={"last": "x"})
    w = Window.partitionBy("key").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("x").over(w).alias("total"), F.max("x").over(w).alias("most"), F.last("x", True).over(w).alias("last"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_one_key_uses_many_tasks(spark):
    """Only a row of totals for each block meets the others of its key."""
    df = signal(spark, 2000)
    got = scan.running(df, ["key"], ["i"], F.floor(F.col("i") / 100), sums={"total": "x"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = got.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1200


@pytest.mark.parametrize("block", [16, 4096])
def test_smoothing_and_slowing(spark, block):
    df = signal(spark)
    x = np.array([r["x"] for r in sorted(df.collect(), key=lambda r: r["i"])])
    y, want = None, []
    for v in x:
        y = v if y is None else 0.3 * y + 0.7 * v
        want.append(y)
    got = [r["smooth"] for r in scan.smoothed(df, ["key"], ["i"], F.floor(F.col("i") / block), "x", 0.3).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-9)

    n, k = len(x), 0.45 * 1.3
    position = np.cumsum(np.rint((1 - k * (np.arange(n) / n) ** 1.6) * scan.TICKS)) / scan.TICKS
    position = position[position < n - 1]
    slow = np.interp(position, np.arange(n), x) * (1 - 0.25 * np.arange(len(position)) / len(position))
    got = scan.run_down(df, 1.3, block).orderBy("i").collect()
    assert [r["i"] for r in got] == list(range(len(position)))
    np.testing.assert_allclose([r["x"] for r in got], slow, atol=1e-9)


def test_clock_and_its_inverse(spark):
    knots = [(1, 0, 0), (1, 10, 100), (1, 30, 120), (1, 60, 600)]
    clock = spark.createDataFrame(knots, "key long, t long, p long")
    asked = spark.createDataFrame([(1, k, t) for k, t in enumerate([-5, 0, 5, 10, 29, 30, 59, 60, 99, None])] + [(2, 50, 3)], "key long, id long, t long")
    for block in (7, 1000):
        got = {r["id"]: r["p"] for r in scan.clock_read(clock, asked, block).collect()}
        want = np.interp([-5, 0, 5, 10, 29, 30, 59, 60, 99], [0, 10, 30, 60], [0, 100, 120, 600])
        assert got.pop(50) is None and [got[k] for k in range(9)] == pytest.approx(want.tolist())
    back = scan.clock_read(clock.selectExpr("key", "p as t", "t as p"), spark.createDataFrame([(1, 1, 50), (1, 2, 110)], "key long, id long, t long"), 50)
    assert {r["id"]: r["p"] for r in back.collect()} == {1: 5.0, 2: 20.0}
    assert scan.clock_read(clock.limit(0), asked.limit(0), 5).count() == 0


def test_plans_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(1, 4000)), int(rng.integers(0, 30)), int(rng.integers(1, 200)), int(rng.integers(0, 90)), int(rng.integers(0, 9))) for k in range(300)]
    df = spark.createDataFrame([*rows, (999, None, 3, 1, 1, 1), (998, 5, None, 1, 1, 1)], "key long, free long, wanted int, fixed long, each long, clip long")
    got = {r["key"]: (r["workers"], r["clips"]) for r in cost.render_plans(df, lambda w, c: F.col("fixed") + w * (F.col("each") + F.col("clip") * c), 9).collect()}
    want = {}
    for key, free, wanted, fixed, each, clip in rows:
        wanted = max(1, wanted)
        most = {w: max([c for c in range(1, wanted + 1) if (fixed + w * (each + clip * c)) * 100 <= free * 80], default=0) for w in range(1, 10)}
        w = next((w for w in range(9, 1, -1) if most[w] >= min(wanted, 8)), 1)
        want[key] = (w, max(1, most[w]))
    assert got == want


def test_needs_beside(spark):
    ops = [(1, 1, "copy", 10), (1, 2, "a", 5), (1, 3, "b", None), (1, 4, "wait", 7), (1, 5, "c", 1), (2, 1, "wait", 3), (2, 2, "a", 2), (2, 3, "copy", 9)]
    got = cost.with_beside(spark.createDataFrame(ops, "key long, position long, op string, need long"), (("copy", "wait"), ("x", "y"))).orderBy("key", "position").collect()
    assert [r["total"] for r in got] == [10, 15, 10, 7, 1, 3, 2, 9]


def test_marked_words(spark):
    captions = spark.createDataFrame([(1, 1, 5, ["a", "b", "a", ""]), (1, 2, 100, ["b"]), (1, 3, None, ["a"]), (1, 4, 7, None), (2, 5, 5, ["a"])], "key long, id long, s long, words array<string>")
    marks = spark.createDataFrame([(1, 9, 6, 8, ["a", "", "a"]), (1, 8, 0, 200, ["b"]), (1, 7, 9, 3, ["a"]), (1, 6, 0, None, ["a"])], "key long, id long, s long, e long, words array<string>")
    for width in (3, 1000):
        got = sorted(tuple(r) for r in highlights.marked_words(captions, marks, width, 1).collect())
        assert got == [(1, 1, 0, 9), (1, 1, 1, 8), (1, 1, 2, 9), (1, 2, 0, 8)]
        assert sorted(tuple(r) for r in highlights.shared_words(captions, marks, width, 1).collect()) == [(1, 1, 8, 1), (1, 1, 9, 1), (1, 2, 8, 1)]


def test_measurements_are_kept_once(spark):
    schema = "op string, t long, id long, peak long"
    path = work.folder(spark, "test-measurements")
    first = spark.createDataFrame([("a", t, t, t * 10) for t in range(15)] + [("b", 1, 100, 5), (None, 1, 101, 6)], schema)
    second = spark.createDataFrame([("a", 20, 20, 1), ("a", None, 21, 2), ("c", 3, 102, 7)], schema)
    for batch in (first, second, second, first):
        measures.record(batch, path)
        seen = sorted(map(tuple, measures.read(spark, path, schema).collect()), key=str)
    assert seen == sorted([("a", t, t, t * 10) for t in range(6, 15)] + [("a", 20, 20, 1), ("b", 1, 100, 5), (None, 1, 101, 6), ("c", 3, 102, 7)], key=str)
    measures.record(first.limit(0), path)
    assert measures.read(spark, path, schema).count() == len(seen)
    assert measures.read(spark, path + "-none", schema).count() == 0
