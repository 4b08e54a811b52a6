"""Samples of things seen over time, and clips: who is where, greedy matching, suppression, focus, zooms, thinning."""

from __future__ import annotations

import math
from itertools import combinations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .folds import fold
from .intervals import binned, overlaps_clipped
from .islands import numbered_runs


def inside(samples: DataFrame, iv: DataFrame, width: int, pad: int = 0) -> DataFrame:
    """Samples (key, t, …) with the intervals (key, id, s, e) they lie in, widened by `pad`; joined by bins of `width`."""
    wide = iv.select("key", "id", (F.col("s") - pad).alias("s"), (F.col("e") + pad).alias("e"))
    points = samples.withColumn("bin", F.floor(F.col("t") / width))
    return points.join(binned(wide, width), ["key", "bin"]).where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e"))).drop("bin")


def present(samples: DataFrame, iv: DataFrame, width: int, least: int = 2) -> DataFrame:
    """(key, id, person, n, rank): persons seen at least `least` times in an interval, most often first."""
    per = inside(samples, iv, width).groupBy("key", "id", "person").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("key", "id").orderBy(F.desc("n"), "person")).cast("long"))


def rebased(samples: DataFrame, iv: DataFrame, width: int, pad: int) -> DataFrame:
    """(key, id, at, person): the track in each padded interval, on the interval's clock."""
    return inside(samples, iv, width, pad).select("key", "id", (F.col("t") - F.col("s")).alias("at"), "person")


def focus(clips: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(key, person, s, e): whom to look at: a clip's own person, else those of the turns that overlap it, clipped to it;
    neighbours of one person become one window."""
    own = clips.where(F.col("person").isNotNull()).select("key", "person", "s", "e")
    open_ = clips.where(F.col("person").isNull()).select("key", "id", "s", "e")
    numbered = turns.withColumn("id", F.row_number().over(Window.partitionBy("key").orderBy("s")).cast("long"))
    met = overlaps_clipped(open_, numbered, width).join(numbered.select("key", F.col("id").alias("b_id"), "person"), ["key", "b_id"]).select("key", "person", "s", "e")
    # a window goes on where the same person follows and nothing lies between
    rows = own.unionByName(met).withColumn("id", F.col("s"))
    w = Window.partitionBy("key").orderBy("s", "e")
    broken = F.coalesce((F.lag("person").over(w) != F.col("person")) | (F.lag("e").over(w) < F.col("s")), F.lit(True))
    runs = rows.withColumn("run", F.sum(broken.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run").agg(F.first("person").alias("person"), F.min("s").alias("s"), F.max("e").alias("e")).drop("run")


def assigned(links: DataFrame, least: float) -> DataFrame:
    """(key, speaker, person): pairs (key, speaker, person, score) taken best first, each speaker and person once. Links of a
    key are speakers times persons: a few dozen."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, speakers, persons = [], set(), set()
        for row in pdf[pdf["score"] >= least].sort_values(["score", "speaker", "person"], ascending=[False, True, True]).itertuples():
            if row.speaker not in speakers and row.person not in persons:
                speakers.add(row.speaker)
                persons.add(row.person)
                out.append((row.key, row.speaker, row.person))
        return pd.DataFrame(out, columns=["key", "speaker", "person"])

    return links.groupBy("key").applyInPandas(run, "key long, speaker long, person long")


#: How much more than usual lips must move, in what share of a speaker's windows a person must be alone, and in
#: what share the only speaker's person must be seen.
LIPS, ALONE, SEEN = 1.15, 0.6, 0.3


def speakers_shown(links: DataFrame) -> DataFrame:
    """(key, speaker, person) of links (key, speaker, person, lips, alone, seen): the most moving lips first, each speaker and
    person once; then, speaker by speaker, the person who is alone most while they speak and isn't taken. The only speaker of
    a recording is the person who is seen most. Of equals the smaller speaker and person come first by lips, the larger
    person by the rest. A null measure is none.

    All candidates come in one order, in which the first that fits is taken; only who is taken is carried on."""
    whole = Window.partitionBy("key")
    only = F.min("speaker").over(whole) == F.max("speaker").over(whole)
    told = links.where("speaker is not null and person is not null").withColumn("_only", only)
    down = lambda c: -F.col(c)
    by = lambda when, phase, first, second, third: F.when(when, F.struct(F.lit(phase).alias("phase"), first.cast("double").alias("a"), second.cast("double").alias("b"), third.cast("double").alias("c")))
    ways = F.array(
        by(F.col("_only") & (F.col("seen") >= SEEN), 0, down("seen"), down("person"), F.lit(0)),
        by(~F.col("_only") & (F.col("lips") >= LIPS), 1, down("lips"), F.col("speaker"), F.col("person")),
        by(~F.col("_only") & (F.col("alone") >= ALONE), 2, F.col("speaker"), down("alone"), down("person")),
    )
    asked = told.select("key", "speaker", "person", F.inline(F.array_compact(ways)))

    def step(taken, phase, a, b, c, speaker, person):
        speakers, persons = taken
        free = speaker not in speakers and person not in persons
        return ((speakers | {speaker}, persons | {person}) if free else taken), (free,)

    walked = fold(asked, ["key"], ["phase", "a", "b", "c"], ["speaker", "person"], "free boolean", lambda: (frozenset(), frozenset()), step)
    return walked.where("free").select("key", "speaker", "person")


def suppressed(boxes: DataFrame, most_overlap: float, most: int = 5000) -> DataFrame:
    """Boxes (key, id, x, y, w, h, score) of a frame, best first, without those that overlap a kept one too much (by the
    share of the common area in both). At most `most` candidates a frame, as the rule has it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).head(most)
        b = pdf[["x", "y", "w", "h"]].to_numpy(float)
        keep: list[int] = []
        for k in range(len(b)):
            x, y, w, h = b[k]
            o = b[keep]
            common = np.maximum(0, np.minimum(x + w, o[:, 0] + o[:, 2]) - np.maximum(x, o[:, 0])) * np.maximum(0, np.minimum(y + h, o[:, 1] + o[:, 3]) - np.maximum(y, o[:, 1]))
            if not len(keep) or (common / np.maximum(w * h + o[:, 2] * o[:, 3] - common, 1e-12)).max() <= most_overlap:
                keep.append(k)
        return pdf.iloc[keep]

    return boxes.groupBy("key").applyInPandas(run, boxes.schema)


def linked(faces: DataFrame, reach: float, hole: int, least_seen: int = 1, alike: float | None = None) -> DataFrame:
    """(key, k, id, track): faces (key, k, id, x, y, w; with `alike` also a unit vector emb) of a video, instant by instant.
    All faces of an instant and all tracks seen at most `hole` instants ago are paired, nearest first: a pair holds if
    neither is taken, they are at most `reach` widths of the wider one apart and, where both have a vector, their product is
    `alike` at least. A face left over opens a track, named by its id. Tracks of fewer than `least_seen` faces go, but for
    the only one of a key. Null places are left out.

    An instant has few faces, so they come as one row; only the last face of each track is carried on."""
    given = ["id", "x", "y", "w", *(["emb"] if alike is not None else [])]
    instants = faces.where("x is not null and y is not null and w is not null").groupBy("key", "k").agg(F.array_sort(F.collect_list(F.struct(*given))).alias("found"))

    def step(tracks, k, found):
        near = {t: v for t, v in tracks.items() if k - v[0] <= hole}
        pairs = sorted((math.hypot(f["x"] - x, f["y"] - y), n, t) for n, f in enumerate(found) for t, (_, x, y, _, _) in near.items())
        of: dict[int, int] = {}
        for d, n, t in pairs:
            _, _, _, width, emb = near[t]
            own = found[n].get("emb")
            apart = alike is not None and own is not None and emb is not None and sum(a * b for a, b in zip(own, emb, strict=False)) < alike
            if n not in of and t not in of.values() and d <= reach * max(found[n]["w"], width) and not apart:
                of[n] = t
        out = []
        for n, f in enumerate(found):
            track = of.get(n, f["id"])
            near[track] = (k, f["x"], f["y"], f["w"], f.get("emb"))
            out.append({"id": f["id"], "track": track})
        return near, (out,)

    walked = fold(instants, ["key"], ["k"], ["found"], "linked array<struct<id:long,track:long>>", dict, step)
    each = walked.select("key", "k", F.explode("linked").alias("l")).select("key", "k", "l.id", "l.track")
    if least_seen <= 1:
        return each
    seen = each.groupBy("key", "track").agg(F.count("*").alias("n"))
    kept = seen.withColumn("tracks", F.count("*").over(Window.partitionBy("key"))).where(f"n >= {least_seen} or tracks = 1")
    return each.join(kept.select("key", "track"), ["key", "track"]).select("key", "k", "id", "track")


def thinned(points: DataFrame, most: int) -> DataFrame:
    """Rows (key, t, id) halved, every second one going, until a key has at most `most`: the number of halvings follows from
    the count, so one window does it."""
    w = Window.partitionBy("key")
    times = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*").over(w) / F.lit(most)))).cast("int")
    k = F.row_number().over(w.orderBy("t", "id")) - 1
    return points.withColumn("_k", k).withColumn("_h", times).where(F.expr("_k % cast(pow(2, _h) as long) = 0")).drop("_k", "_h")


def zooms(marks: DataFrame, target: int, least: int, margin: int) -> DataFrame:
    """(key, s, e, side): a clip (key) of marks (t) and its end, cut into zooms: from each start the next boundary is the mark
    nearest `target` later, the earlier of equals, that lies at least `least` later and `margin` before the end, else the
    end; sides alternate. Marks without a time are left out.

    Marks are walked in order with the best one so far: once a mark lies further from the target than that, or at the clip's
    last mark, the boundary is settled. Each mark gives the zooms that it settles."""
    timed = marks.where("t is not null and end is not null").select("key", "t", "end")
    last = F.lead("t").over(Window.partitionBy("key").orderBy("t")).isNull()

    def step(state, t, end, closing):
        at, side, waiting = state if state else (t, 0, [])
        out = []
        waiting = [x for x in waiting if x >= at + least] + [t]
        while True:
            fit = [x for x in waiting if at + least <= x < end - margin]
            best = min(fit, key=lambda x: (abs(x - at - target), x), default=None)
            settled = best is not None and abs(t - at - target) > abs(best - at - target) and t > at + target
            if not settled and not closing:
                break
            upto = best if best is not None else end
            out.append({"s": at, "e": upto, "side": side % 2})
            at, side = upto, side + 1
            waiting = [x for x in waiting if x > at]
            if at >= end:
                break
        return (at, side, waiting), (out,)

    walked = fold(timed.withColumn("closing", last), ["key"], ["t"], ["end", "closing"], "cut array<struct<s:long,e:long,side:long>>", lambda: None, step)
    return walked.select("key", F.explode("cut").alias("c")).select("key", "c.s", "c.e", "c.side")


def nearest_clip(points: DataFrame, clips: DataFrame) -> DataFrame:
    """(key, id, clip): for each point of a moment the clip of that moment that contains it, else the nearest, the first of
    equals. A moment has few clips: the join is by the moment."""
    both = points.select("key", "id", "t").join(clips.select("key", F.col("id").alias("clip"), "s", "e"), "key")
    away = F.greatest(F.col("s") - F.col("t"), F.col("t") - F.col("e"), F.lit(0))
    return both.groupBy("key", "id").agg(F.min(F.struct(away.alias("away"), "s", "clip")).alias("m")).select("key", "id", "m.clip")


def largest(faces: DataFrame) -> DataFrame:
    """(key, person, k, id): each person's widest face, the first of equals."""
    best = F.min(F.struct((-F.col("w")).alias("w"), "k", "id")).alias("m")
    return faces.groupBy("key", "person").agg(best).select("key", "person", "m.k", "m.id")


def united_boxes(faces: DataFrame, share: float = 0.3) -> DataFrame:
    """(key, k, x, y, w, h): the box around all faces of an instant that are at least `share` as wide as its widest."""
    wide = faces.withColumn("_m", F.max("w").over(Window.partitionBy("key", "k"))).where(F.col("w") >= share * F.col("_m"))
    box = wide.groupBy("key", "k").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("r"), F.max(F.col("y") + F.col("h")).alias("b"))
    return box.select("key", "k", "x", "y", (F.col("r") - F.col("x")).alias("w"), (F.col("b") - F.col("y")).alias("h"))


def steady(panels: DataFrame, reach: int, least: float = 0.4) -> DataFrame:
    """(key, t, x): the seventh decile of a value over `reach` either way in time, where at least `least` of the samples there
    have one."""
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-reach, reach)
    seen = panels.select("key", "t", F.count("*").over(w).alias("n"), F.array_sort(F.collect_list("x").over(w)).alias("xs"))
    at = 0.7 * (F.size("xs") - 1)
    low, high = F.get("xs", F.floor(at).cast("int")), F.get("xs", F.ceil(at).cast("int"))
    return seen.where(F.size("xs") >= least * F.col("n")).where(F.size("xs") > 0).select("key", "t", (low + (high - low) * (at - F.floor(at))).alias("x"))


def short_islands(words: DataFrame, longest: int) -> DataFrame:
    """(key, run, s, e, n): runs of marked words (key, i, marked) of up to `longest` words between unmarked ones."""
    runs = numbered_runs(words, "marked", ["i"]).groupBy("key", "run").agg(F.first("marked").alias("marked"), F.min("i").alias("s"), F.max("i").alias("e"), F.count("*").alias("n"))
    w = Window.partitionBy("key").orderBy("run")
    around = F.lag("run").over(w).isNotNull() & F.lead("run").over(w).isNotNull()
    return runs.withColumn("_a", around).where(F.col("marked") & F.col("_a") & (F.col("n") <= longest)).drop("marked", "_a")


def short_islands_of_lists(texts: DataFrame, longest: int) -> DataFrame:
    """short_islands() of texts (key, marked: a list), inside their rows; a null stands for no word and keeps its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("marked")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            kept = flat.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)[kept]
            place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[kept]
            marked = flat.fill_null(False).to_numpy(zero_copy_only=False)[kept]
            first = np.ones(len(row) + 1, bool)
            first[1:-1] = (row[1:] != row[:-1]) | (marked[1:] != marked[:-1])
            at = np.flatnonzero(first[:-1]) if len(row) else np.zeros(0, np.int64)
            n = np.diff(np.append(at, len(row)))
            of = row[at]
            number = np.arange(len(at)) - np.searchsorted(of, of) + 1
            same = np.concatenate(([False], of[1:] == of[:-1], [False])) if len(at) else np.zeros(1, bool)
            told = np.flatnonzero(marked[at] & (n <= longest) & same[:-1] & same[1:])
            columns = [number[told], place[at[told]], place[at[told] + n[told] - 1], n[told]]
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(of[told])).cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], ["key", "run", "s", "e", "n"])

    return texts.select("key", "marked").mapInArrow(run, "key long, run long, s long, e long, n long")


def split_at_clips(part: DataFrame, clips: DataFrame, most: int) -> DataFrame:
    """(key, part, s, e, n): a key's clips (key, id, s, e) in parts of up to `most` clips, by rank."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("s", "id")) - 1
    placed = clips.join(part.select("key").distinct(), "key", "left_semi").withColumn("part", F.floor(rank / most))
    return placed.groupBy("key", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n"))


def halves(clips: DataFrame) -> DataFrame:
    """(key, at): the clip start nearest the middle of a key's span, the earlier of equals, not its first."""
    span = clips.withColumn("_a", F.min("s").over(Window.partitionBy("key"))).withColumn("_b", F.max("e").over(Window.partitionBy("key")))
    away = F.abs(2 * F.col("s") - F.col("_a") - F.col("_b"))
    return span.where(F.col("s") > F.col("_a")).groupBy("key").agg(F.min(F.struct(away.alias("d"), "s")).alias("m")).select("key", F.col("m.s").alias("at"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def line_layout(widths: pd.Series, lines: pd.Series) -> pd.Series:
    """After which words to break so many lines: the least difference between the widest and the narrowest, then the least
    widest, then the earliest breaks. A null list has no words, a null width none, a null number of lines is one."""

    def best(w, n):
        n = max(1, min(int(n), len(w)))
        total = np.concatenate(([0], np.cumsum(w)))

        def cost(cut):
            ends = [0, *cut, len(w)]
            sizes = [total[b] - total[a] for a, b in zip(ends, ends[1:], strict=False)]
            return max(sizes) - min(sizes), max(sizes), cut

        return list(min((cost(c) for c in combinations(range(1, len(w)), n - 1)), default=(0, 0, ()))[2])

    return pd.Series([best([0 if x is None or x != x else x for x in ([] if w is None else w)], 1 if n is None or n != n else n) for w, n in zip(widths, lines, strict=True)])
