"""Column functions of frames, sizes and running jobs. All are built-in expressions; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import gcd

#: Shapes that have a name, in the order in which they are tried, and those that a working copy snaps to.
NAMED_RATIOS = ((16, 9), (9, 16), (1, 1), (4, 5), (5, 4), (4, 3), (3, 4), (21, 9), (3, 2), (2, 3))
COMMON_RATIOS = ((9, 16), (16, 9), (4, 3), (3, 4), (1, 1), (4, 5), (5, 4), (2, 3), (3, 2))


def ratio_name(w: Column, h: Column) -> Column:
    """A shape in common words, within a hundredth; else the reduced fraction; '?' without a size."""
    shape, d = w / F.nullif(h, F.lit(0)), F.greatest(gcd(w, h), F.lit(1))
    out = F.when((w == 0) | (h == 0), "?")
    for a, b in NAMED_RATIOS:
        out = out.when(F.abs(shape - a / b) / shape < 0.01, f"{a}:{b}")
    return out.otherwise(F.concat((w / d).cast("long").cast("string"), F.lit(":"), (h / d).cast("long").cast("string")))


def even_up(x: Column) -> Column:
    """The nearest even whole number, at least 2; halves go up."""
    return F.greatest(F.lit(2).cast("long"), (F.round(x / 2) * 2).cast("long"))


def even_half(x: Column) -> Column:
    """The nearest even whole number, at least 2; halves go to the even half."""
    return F.greatest(F.lit(2).cast("long"), (F.bround(x / 2) * 2).cast("long"))


def fit_inside(sw: Column, sh: Column, dw: int, dh: int) -> Column:
    """struct<w, h>: a whole image laid into a target, in even sizes."""
    sw, sh = F.greatest(sw, F.lit(1)).cast("double"), F.greatest(sh, F.lit(1)).cast("double")
    wide = sw / sh > dw / dh
    low = F.least(even_up(dw * 1.0 * sh / sw), F.lit(dh).cast("long"))
    narrow = F.least(even_up(dh * 1.0 * sw / sh), F.lit(dw).cast("long"))
    return F.when(wide, F.struct(F.lit(dw).cast("long").alias("w"), low.alias("h"))).otherwise(F.struct(narrow.alias("w"), F.lit(dh).cast("long").alias("h")))


def work_size(w: Column, h: Column, short: int) -> Column:
    """struct<w, h>: the same shape, snapped to a common one within a hundredth, with a short side of `short`;
    sides count as 1 at least."""
    w, h = F.greatest(w, F.lit(1)), F.greatest(h, F.lit(1))
    shape = w / h
    a, b = w.cast("double"), h.cast("double")
    for x, y in reversed(COMMON_RATIOS):
        near = F.abs(shape / (x / y) - 1) < 0.01
        a, b = F.when(near, F.lit(float(x))).otherwise(a), F.when(near, F.lit(float(y))).otherwise(b)
    side = F.lit(short).cast("long")
    return F.when(a <= b, F.struct(side.alias("w"), even_half(b * float(short) / a).alias("h"))).otherwise(F.struct(even_half(a * float(short) / b).alias("w"), side.alias("h")))


def same_ratio(sw: Column, sh: Column, dw: Column, dh: Column) -> Column:
    target = dw / F.greatest(dh, F.lit(1))
    return F.abs(sw / F.greatest(sh, F.lit(1)) - target) / target < 0.01


def cadence(native: Column, halve: Column) -> Column:
    """Images a second of a montage: every second one of a source of 48 and more, where asked for."""
    return F.when(halve & (native >= 48), F.floor(native / 2)).otherwise(native).cast("long")


def rate_for(kbps: Column, fps: Column) -> Column:
    """A bit rate, half as much again above 30.5 images a second."""
    return F.when(fps > 30.5, F.floor(kbps * 3 / 2)).otherwise(kbps).cast("long")


def margin_box(x: Column, y: Column, w: Column, h: Column, alone: Column) -> Column:
    """struct<x0, y0, x1, y1>: a face with some room around it, or just the face of someone alone."""
    side, up, down = F.when(alone, 0.5).otherwise(0.75), F.when(alone, 0.5).otherwise(0.8), F.when(alone, 0.5).otherwise(0.9)
    return F.struct((x - side * w).alias("x0"), (y - up * h).alias("y0"), (x + side * w).alias("x1"), (y + down * h).alias("y1"))


def widest_zoom(px: Column, py: Column, box: Column, most: float) -> Column:
    """The largest zoom around a point, 1 to `most`, that keeps a box inside the image."""
    out = F.lit(most)
    for p, low, high in ((px, F.greatest(box["x0"], F.lit(0.0)), F.least(box["x1"], F.lit(1.0))), (py, F.greatest(box["y0"], F.lit(0.0)), F.least(box["y1"], F.lit(1.0)))):
        before, after = p - low > 1e-6, high - p > 1e-6
        out = F.least(out, F.when(before, p / F.when(before, p - low)).otherwise(F.lit(most)), F.when(after, (1 - p) / F.when(after, high - p)).otherwise(F.lit(most)))
    return F.greatest(out, F.lit(1.0))


def trimmed(x: Column) -> Column:
    """Six decimals without zeros at the end."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def iso_time(micros: Column) -> Column:
    """ISO 8601 in UTC of microseconds since 1970; no decimals on a whole second. The session's time zone doesn't matter."""
    seconds, rest = F.floor(micros / 1_000_000), F.pmod(micros, F.lit(1_000_000))
    day, second = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%sT%02d:%02d:%02d", day.cast("string"), F.floor(second / 3600), F.floor(second / 60) % 60, second % 60)
    return F.concat(clock, F.when(rest == 0, "").otherwise(F.format_string(".%06d", rest)), F.lit("+00:00"))


def time_left(share: Column, began_at: Column, elapsed: Column, model: Column) -> Column:
    """Time left of a job `share` done of which `began_at` was done when it began, after `elapsed`: the modelled time at
    first, the measured speed more and more until a quarter more is done. `model` is the time of the whole job."""
    by_model = model * (1 - share)
    more = share - began_at
    live = F.when((more > 0) & (elapsed > 3), elapsed * (1 - share) / F.when(more > 0, more)).otherwise(by_model)
    weight = F.least(more / 0.25, F.lit(1.0))
    return weight * live + (1 - weight) * by_model


def montage_seconds(frames: Column, fps: Column, source_seconds: Column) -> Column:
    """Exact where it is known, else six tenths of the source."""
    return F.coalesce(frames / F.nullif(fps, F.lit(0)), 0.6 * source_seconds)
