"""What a media tool tells of a file, as structs: tracks, formats, settings for joining, exact frame rates.

All are column functions over the tool's text, so they run on whatever Spark's text source reads, from any store, whole or as
a stream.

Defined cases. A null text, or one without the line in question, gives nulls, zeros or an empty array as each function says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S

from .documents import duration

# The lines and fields of the tool's text, and the rates that broadcasting defines by a fraction.
AUDIO = r"Stream #\d+:\d+.*?: Audio: (.*)"
VIDEO = r"Stream #\d+:\d+.*?: Video: (.*)"
SIZE = r"(?:^|, )(\d{2,5})x(\d{2,5})(?:[ ,]|$)"
CODEC = r"(?:Video|Audio): (\w+)"
TURN = r"rotation of (-?[\d.]+) degrees"
BROADCAST = (("23.98", 24000), ("23.976", 24000), ("29.97", 30000), ("47.95", 48000), ("59.94", 60000), ("119.88", 120000))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null where nothing matches or the group is empty."""
    return let(F.regexp_extract(text, pattern, group), lambda x: F.nullif(x, F.lit("")))


def audio_tracks(probe: Column) -> Column:
    """array<struct<track, description>> of the audio tracks that can be decoded; track numbers count the others too."""
    every = F.transform(F.regexp_extract_all(F.coalesce(probe, F.lit("")), F.lit(AUDIO), 1), lambda d, i: F.struct(i.alias("track"), d.alias("description")))
    return F.filter(every, lambda t: ~t["description"].startswith("none"))


def media(probe: Column) -> Column:
    """struct<duration, width, height, fps, video_codec, video_kbps, has_audio, audio_codec, audio_kbps>: the first line that
    tells of a picture and the first that tells of sound; zeros and empty texts for what isn't told."""
    lines = F.split(F.coalesce(probe, F.lit("")), r"\r?\n")
    # a picture's line without a size leaves the search open for the next one
    sized = F.get(F.filter(lines, lambda x: x.contains("Video:") & x.rlike(SIZE)), 0)
    video = F.coalesce(sized, F.try_element_at(F.filter(lines, lambda x: x.contains("Video:")), F.lit(-1)))
    audio = F.get(F.filter(lines, lambda x: x.contains("Audio:") & (~x.contains("Video:"))), 0)
    number = lambda line, pattern, k=1: F.coalesce(found(line, pattern, k).try_cast("double"), F.lit(0.0))
    return F.struct(
        duration(probe).alias("duration"),
        number(video, SIZE).cast("int").alias("width"),
        number(video, SIZE, 2).cast("int").alias("height"),
        number(video, r", ([\d.]+) fps").alias("fps"),
        F.coalesce(found(video, CODEC), F.lit("")).alias("video_codec"),
        number(video, r", (\d+) kb/s").alias("video_kbps"),
        audio.isNotNull().alias("has_audio"),
        F.coalesce(found(audio, CODEC), F.lit("")).alias("audio_codec"),
        number(audio, r", (\d+) kb/s").alias("audio_kbps"),
    )


def flat(line: Column) -> Column:
    """Fields between commas without what stands in parentheses, however deep: innermost first, as often as a line has any."""
    rounds = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(line) - F.length(F.replace(line, F.lit("("), F.lit("")))))
    bare = F.aggregate(rounds, line, lambda text, _: F.regexp_replace(text, r"\([^()]*\)", ""))
    return F.transform(F.split(bare, ","), lambda x: F.trim(x))


def settings(probe: Column) -> Column:
    """struct<duration, codec, pixels, width, height, fps, turn, tracks, audio_codec, rate, layout> for joining files; null where
    there is no picture."""
    with_sound = lambda p, video, fields, audio: let(flat(audio), lambda sound: let(audio_tracks(p), lambda tracks: settings_of(p, video, fields, audio, sound, tracks)))
    with_picture = lambda p, video: let(flat(video), lambda fields: let(found(p, AUDIO), lambda audio: with_sound(p, video, fields, audio)))
    return let(probe, lambda p: let(found(p, VIDEO), lambda video: F.when(video.isNotNull(), with_picture(p, video))))


def settings_of(probe: Column, video: Column, fields: Column, audio: Column, sound: Column, tracks: Column) -> Column:
    """settings() from the text, its first lines of picture and sound with their fields, and its tracks."""
    size = F.get(F.filter(fields, lambda x: x.rlike(r"^\d+x\d+")), 0)
    number = lambda text, pattern, k=1: found(text, pattern, k).try_cast("double")
    heard = lambda c: F.when(audio.isNotNull() & (F.size(tracks) > 0), c)
    word = lambda c: F.coalesce(F.get(F.filter(F.split(c, r"\s+"), lambda x: x != ""), 0), F.lit(""))
    return F.struct(
        duration(probe).alias("duration"),
        word(F.get(fields, 0)).alias("codec"),
        F.coalesce(F.get(fields, 1), F.lit("")).alias("pixels"),
        F.coalesce(number(size, r"^(\d+)x(\d+)"), F.lit(0.0)).cast("int").alias("width"),
        F.coalesce(number(size, r"^(\d+)x(\d+)", 2), F.lit(0.0)).cast("int").alias("height"),
        F.coalesce(number(video, r"([\d.]+) fps"), number(video, r"([\d.]+) tbr"), F.lit(30.0)).alias("fps"),
        F.pmod(F.coalesce(F.rint(number(probe, TURN)), F.lit(0.0)).cast("int"), F.lit(360)).alias("turn"),
        F.transform(tracks, lambda t: t["track"]).alias("tracks"),
        heard(word(F.get(sound, 0))).alias("audio_codec"),
        heard(F.coalesce(F.get(sound, 1), F.lit(""))).alias("rate"),
        heard(F.coalesce(F.get(sound, 2), F.lit(""))).alias("layout"),
    )


def same_settings(files: DataFrame, by: list[str], *also: Column) -> DataFrame:
    """(…by, files, same, …also): whether all of a group's files (…by, settings) have sound and could be joined without encoding."""
    s = F.col("settings")
    one = F.struct(*[s[c].alias(c) for c in ("codec", "pixels", "width", "height", "fps", "turn", "audio_codec", "rate", "layout", "tracks")])
    heard = F.coalesce(s["audio_codec"], F.lit("")) != ""
    return files.groupBy(*by).agg(F.count("*").alias("files"), (F.bool_and(heard) & (F.min(one) == F.max(one))).alias("same"), *also)


def example(probe: Column) -> Column:
    """struct<duration, width, height>: the coded size, turned by a rotation of a quarter."""
    w, h = (F.coalesce(found(probe, r"Video: .*?, (\d{2,5})x(\d{2,5})", k).try_cast("int"), F.lit(0)) for k in (1, 2))
    turned = F.coalesce(F.rint(F.abs(found(probe, TURN).try_cast("double"))).cast("int") % 180 == 90, F.lit(False))
    return F.struct(duration(probe).alias("duration"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def with_rate(files: DataFrame, probe: str) -> DataFrame:
    """With `rate`, struct<n, d>: the nominal frame rate as a fraction, else the average one, else 30; between 1 and 120."""
    video = found(F.col(probe), VIDEO)
    told = files
    for name in ("tbr", "fps"):
        text = F.when(F.regexp_extract(video, rf"([\d.]+)(k?) {name}", 2) == "", found(video, rf"([\d.]+)(k?) {name}"))
        told = told.withColumn(f"_{name}", text)
    for name in ("fps", "tbr"):
        text = F.col(f"_{name}")
        near = S.limited_fraction(F.coalesce(text.try_cast("double"), F.lit(0.0)), F.lit(1000))
        rate = F.struct(near["n"].alias("n"), near["d"].alias("d"))
        for shown, n in BROADCAST:
            rate = F.when(text == shown, F.struct(F.lit(n).cast("long").alias("n"), F.lit(1001).cast("long").alias("d"))).otherwise(rate)
        told = told.withColumn(f"_r_{name}", rate)
    fits = lambda r: F.when((r["n"] >= r["d"]) & (r["n"] <= 120 * r["d"]), r)
    out = F.coalesce(fits(F.col("_r_tbr")), fits(F.col("_r_fps")), F.struct(F.lit(30).cast("long").alias("n"), F.lit(1).cast("long").alias("d")))
    return told.select(*files.columns, out.alias("rate"))
