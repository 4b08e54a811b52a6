"""Panels of faces over time: what is usual around an instant by order statistics of a sliding range, and missing panels from
the same person's nearest.

The rows of a track are read in order of time; those of the range are kept in four ordered lists, one for each edge, so a worker
holds a range once, whatever its density, and no row carries an array of its neighbours.

Defined cases. Rows without a time are left out; a panel with a null edge is none; a null key is a track of its own. Rows of
one time are read in any order and all count. Empty tables give empty results."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import asof

EDGES = ("x0", "y0", "x1", "y1")
#: Which share of the values lies below an edge that is taken (the tighter side), shares of instants with a panel
#: that are wanted around an instant and in a whole track.
SHARES, AROUND, WHOLE = (0.7, 0.7, 0.3, 0.3), 0.4, 0.25


def quantile(ordered: list[float], share: float) -> float:
    at = share * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


class Range:
    """The rows of a sliding range of time, and their edges in order."""

    def __init__(self) -> None:
        self.rows: deque = deque()  # (t, edges or None)
        self.edges: list[list[float]] = [[], [], [], []]

    def add(self, t: int, edges: tuple | None) -> None:
        self.rows.append((t, edges))
        for ordered, x in zip(self.edges, edges or ()):
            insort(ordered, x)

    def drop_before(self, t: int) -> None:
        while self.rows and self.rows[0][0] < t:
            for ordered, x in zip(self.edges, self.rows.popleft()[1] or ()):
                del ordered[bisect_left(ordered, x)]

    def usual(self) -> tuple | None:
        n = len(self.edges[0])
        return tuple(map(quantile, self.edges, SHARES)) if n and n >= AROUND * len(self.rows) else None


def usual_panels(faces: DataFrame, reach: int) -> DataFrame:
    """(key, t, id, x0, y0, x1, y1) of a track's faces (key, t, id, and the panel's edges, null where none was found): what is
    usual up to `reach` either way, where enough instants there have a panel; null elsewhere."""
    kind = dict(faces.dtypes)["key"]
    rows = faces.where("t is not null").select("key", F.col("t").cast("long").alias("t"), F.col("id").cast("long").alias("id"), *[F.col(e).cast("double").alias(e) for e in EDGES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, waiting, key_type = object(), Range(), deque(), None

        def told(upto: int | None) -> Iterator[tuple]:
            """Instants whose range has been read, those before `upto`; all, where it is None."""
            while waiting and (upto is None or waiting[0][0] + reach < upto):
                t, id_ = waiting.popleft()
                seen.drop_before(t - reach)
                yield (last, t, id_, *(seen.usual() or (None,) * 4))

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 7
            types = [key_type, pa.int64(), pa.int64(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "t", "id", *EDGES])

        for batch in batches:
            key_type = batch.column("key").type
            out: list[tuple] = []
            for key, t, id_, *edges in zip(*(batch.column(c).to_pylist() for c in ("key", "t", "id", *EDGES)), strict=True):
                if key != last:
                    out.extend(told(None))
                    last, seen, waiting = key, Range(), deque()
                out.extend(told(t))
                seen.add(t, None if any(e is None for e in edges) else tuple(edges))
                waiting.append((t, id_))
            yield packed(out)
        if key_type is not None:
            yield packed(list(told(None)))

    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, f"key {kind}, t long, id long, x0 double, y0 double, x1 double, y1 double")


def inside(x: Column, y: Column, box: dict[str, Column]) -> Column:
    return x.between(box["x0"], box["x1"]) & y.between(box["y0"], box["y1"])


def steady_panels(faces: DataFrame, reach: int) -> DataFrame:
    """(key, t, id, x0, y0, x1, y1) of faces (key, t, id, x, y, and the panel's edges): the usual panel around an instant, else the
    track's own, if a quarter of its instants have one and the face is inside it; instants with neither are left out."""
    found = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    timed = faces.where("t is not null")
    own = timed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n"), F.count_if(found).alias("_found"), *[F.percentile(F.when(found, F.col(e).cast("double")), share).alias(f"_{e}") for e, share in zip(EDGES, SHARES)])
    around = usual_panels(faces, reach).select(F.col("key").alias("_k"), F.col("t").alias("_t"), F.col("id").alias("_id"), *[F.col(e).alias(f"u_{e}") for e in EDGES])
    told = timed.join(around, F.col("key").eqNullSafe(F.col("_k")) & (F.col("t") == F.col("_t")) & (F.col("id") == F.col("_id"))).join(own, F.col("key").eqNullSafe(F.col("_key")))
    fits = (F.col("_found") >= WHOLE * F.col("_n")) & inside(F.col("x"), F.col("y"), {e: F.col(f"_{e}") for e in EDGES})
    edges = [F.when(F.col("u_x0").isNotNull(), F.col(f"u_{e}")).when(fits, F.col(f"_{e}")).alias(e) for e in EDGES]
    return told.select("key", "t", "id", *edges).where("x0 is not null")


def filled_panels(faces: DataFrame, panels: DataFrame, within: int) -> DataFrame:
    """(person, t, id, x0, y0, x1, y1): faces (person, t, id, x, y) with their panel (person, t, id, edges) or, where they have none
    and others are in the picture (`alone` false), the same person's nearest in time, the earlier of equals, up to `within`
    away, if the face is inside it."""
    have = panels.select("person", "t", "id", *EDGES)
    missing = faces.where(~F.col("alone")).join(have.select("person", "t", "id"), ["person", "t", "id"], "left_anti")
    near = asof.nearest(missing.select(F.col("person").alias("key"), "id", "t"), have.select(F.col("person").alias("key"), "id", "t"), within)
    near = near.where("match_id is not null").select(F.col("key").alias("person"), "t", "id", "match_id", "match_t")
    known = have.select(F.col("person").alias("_p"), F.col("t").alias("_t"), F.col("id").alias("_id"), *EDGES)
    lent = near.join(known, (F.col("person") == F.col("_p")) & (F.col("match_t") == F.col("_t")) & (F.col("match_id") == F.col("_id")))
    lent = lent.join(missing.select("person", "t", "id", "x", "y"), ["person", "t", "id"]).where(inside(F.col("x"), F.col("y"), {e: F.col(e) for e in EDGES}))
    return have.unionByName(lent.select("person", "t", "id", *EDGES))
