"""Panels of faces against plain versions, also in a dense range."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators import panels

FACES = "key long, t long, id long, x double, y double, x0 double, y0 double, x1 double, y1 double"


def faces(rng, key, n, step):
    rows, t = [], 0
    for k in range(n):
        t += int(rng.integers(0, step))
        box = [float(rng.integers(0, 40)), float(rng.integers(0, 40)), float(rng.integers(50, 99)), float(rng.integers(50, 99))] if rng.random() < 0.45 else [None] * 4
        rows.append((key, t, k, float(rng.integers(0, 99)), float(rng.integers(0, 99)), *box))
    return rows


def usual(boxes):
    return tuple(float(np.percentile([b[k] for b in boxes], share)) for k, share in enumerate((70, 70, 30, 30)))


def plain_steady(rows, reach):
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        every = [r[5:] for r in own if r[5] is not None]
        whole = usual(every) if every and len(every) >= 0.25 * len(own) else None
        for r in own:
            near = [o[5:] for o in own if abs(o[1] - r[1]) <= reach]
            found = [b for b in near if b[0] is not None]
            if found and len(found) >= 0.4 * len(near):
                out[key, r[2]] = usual(found)
            elif whole and whole[0] <= r[3] <= whole[2] and whole[1] <= r[4] <= whole[3]:
                out[key, r[2]] = whole
    return out


@pytest.mark.parametrize("reach", [0, 3, 40])
def test_steady(spark, reach):
    rng = np.random.default_rng(reach)
    rows = [r for key in (1, 2, 3, None) for r in faces(rng, key, 60, 5)]
    got = {(r["key"], r["id"]): tuple(r[e] for e in panels.EDGES) for r in panels.steady_panels(spark.createDataFrame(rows, FACES).repartition(4), reach).collect()}
    want = plain_steady(rows, reach)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_dense_range(spark):
    """Twenty thousand rows in one range: kept once, not once a row."""
    rng = np.random.default_rng(9)
    rows = faces(rng, 1, 20_000, 2)
    got = panels.usual_panels(spark.createDataFrame(rows, FACES), 10**6).where("x0 is not null")
    want = usual([r[5:] for r in rows if r[5] is not None])
    assert got.count() == 20_000 and tuple(got.first()[e] for e in panels.EDGES) == pytest.approx(want)


def test_filled(spark):
    have = [(1, 100, 1, 0.0, 0.0, 10.0, 10.0), (1, 130, 2, 0.0, 0.0, 4.0, 4.0), (2, 100, 3, 0.0, 0.0, 9.0, 9.0)]
    asked = [(1, 110, 4, 5.0, 5.0, False), (1, 115, 5, 5.0, 5.0, False), (1, 125, 6, 5.0, 5.0, False), (1, 126, 7, 3.0, 3.0, False), (1, 127, 8, 3.0, 3.0, True), (1, 200, 9, 3.0, 3.0, False), (3, 100, 10, 1.0, 1.0, False), (1, 100, 1, 5.0, 5.0, False)]
    got = panels.filled_panels(spark.createDataFrame(asked, "person long, t long, id long, x double, y double, alone boolean"), spark.createDataFrame(have, "person long, t long, id long, x0 double, y0 double, x1 double, y1 double"), 15)
    # at 115 both are equally near: the earlier; at 125 the nearest doesn't hold the face; 200 is too far
    assert sorted((r["id"], r["x1"]) for r in got.collect()) == [(1, 10.0), (2, 4.0), (3, 9.0), (4, 10.0), (5, 10.0), (7, 4.0)]


def test_nothing(spark):
    none = spark.createDataFrame([], FACES)
    assert panels.steady_panels(none, 3).count() == 0 and panels.usual_panels(none, 3).count() == 0
    blank = spark.createDataFrame([(1, None, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 5, 2, 1.0, 1.0, None, 1.0, 1.0, 1.0)], FACES)
    assert panels.steady_panels(blank, 3).count() == 0 and panels.usual_panels(blank, 3).count() == 1
