"""Documents of unknown shape as VARIANT columns: coercions, ids that are equal across types, patches, checked settings.

Defined cases. A missing or null VARIANT is null, which isn't true, has no number and matches no id; what isn't an object has
no fields, what isn't an array no elements. Of patches with the same time the largest id is the last; equal ids may change
places. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S


def kind(v: Column) -> Column:
    """null, boolean, number, text, array or object."""
    told = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (told == "VOID"), "null")
        .when(told == "BOOLEAN", "boolean")
        .when(told == "STRING", "text")
        .when(told.startswith("ARRAY"), "array")
        .when(told.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def read(v: Column, to: str) -> Column:
    return F.try_variant_get(v, "$", to)


def elements(v: Column) -> Column:
    return F.when(kind(v) == "array", read(v, "array<variant>")).otherwise(F.array().cast("array<variant>"))


def fields(v: Column) -> Column:
    """map<string, variant> of an object; empty for anything else."""
    return F.when(kind(v) == "object", read(v, "map<string,variant>")).otherwise(F.create_map().cast("map<string,variant>"))


def truthy(v: Column) -> Column:
    told = kind(v)
    return (
        F.when(told == "boolean", read(v, "boolean"))
        .when(told == "number", read(v, "double") != 0)
        .when(told == "text", F.length(read(v, "string")) > 0)
        .when(told == "array", F.size(elements(v)) > 0)
        .when(told == "object", F.size(fields(v)) > 0)
        .otherwise(F.lit(False))
    )


def is_number(v: Column) -> Column:
    """Numbers, and booleans, which count as numbers."""
    return kind(v).isin("number", "boolean")


def number(v: Column) -> Column:
    """float(x), or null: numbers, booleans as 0 and 1, and texts that tell a number."""
    text = F.regexp_replace(F.trim(read(v, "string")), "_", "")
    told = kind(v)
    return F.when(told == "number", read(v, "double")).when(told == "boolean", read(v, "boolean").cast("double")).when((told == "text") & text.rlike(r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"), text.try_cast("double"))


def whole(v: Column) -> Column:
    """int(x), or null: numbers are cut towards zero, a text must be a whole number."""
    told = kind(v)
    return F.when(told == "number", read(v, "double").try_cast("long")).when(told == "boolean", read(v, "boolean").cast("long")).when(told == "text", S.as_long(F.regexp_replace(read(v, "string"), "_", "")))


def same_id(v: Column, id_: Column) -> Column:
    """3.0 is 3 and true is 1; a text is never an id."""
    return F.coalesce(is_number(v) & (number(v) == id_.cast("double")), F.lit(False))


def contains(keep: Column, id_: Column) -> Column:
    return F.exists(elements(keep), lambda x: same_id(x, id_))


def kept(keep: Column, id_: Column) -> Column:
    """Whether an id, or a part of it ('7/2' of 7), is on a list."""
    part = lambda x: F.when(kind(x) == "text", F.split_part(read(x, "string"), F.lit("/"), F.lit(1)) == id_.cast("string")).otherwise(F.lit(False))
    return F.exists(elements(keep), lambda x: same_id(x, id_) | part(x))


def either(a: Column, b: Column) -> Column:
    """a if it counts as true, else b."""
    return F.when(truthy(a), a).otherwise(b)


# ---------------------------------------------------------------- patches

#: The settings of a sound, and of what is laid over the picture: (name, rule, low, high, digits).
SOUND = (("voice", "number", 0.0, 2.0, 2), ("denoise", "whole", 0.0, 3.0, 0), ("loudness", "level", -30.0, -8.0, 0), ("highpass", "flag", None, None, None), ("declick", "flag", None, None, None), ("clarity", "flag", None, None, None), ("mute", "spans", None, None, 2))
OVERLAY = (("autoZoom", "number", 0.0, 2.0, 2), ("pop", "flag", None, None, None), ("karaoke", "flag", None, None, None), ("speakerFocus", "flag", None, None, None), ("karaokeColor", "colour", None, None, None))
MOST_SPANS = 200

Rules = tuple[tuple[str, str, float | None, float | None, int | None], ...]


def is_false(v: Column) -> Column:
    return (kind(v) == "boolean") & ~read(v, "boolean")


def span_ends(v: Column) -> Column:
    """The two numbers of a pair, else null."""
    pair = elements(v)
    return F.when(F.size(pair) == 2, F.array(number(F.get(pair, 0)), number(F.get(pair, 1))))


def readable(v: Column, rule: str) -> Column:
    """Whether a value can be taken; a body with one that can't is refused whole."""
    if rule == "number":
        return number(v).isNotNull()
    if rule == "whole":
        return whole(v).isNotNull()
    if rule == "level":
        return is_false(v) | number(v).isNotNull()
    if rule == "spans":
        ends = F.transform(elements(v), span_ends)
        return (kind(v) == "array") & F.forall(ends, lambda e: F.coalesce(F.get(e, 0).isNotNull() & F.get(e, 1).isNotNull(), F.lit(False)))
    return F.lit(True)


def accepted(body: Column, rules: Rules) -> Column:
    """Whether a body can be taken: an object whose known settings are null or readable. One function goes over its fields."""

    def refused(name: Column, v: Column) -> Column:
        out = F.lit(False)
        for rule in sorted({r[1] for r in rules} - {"flag", "colour"}):
            out = F.when(name.isin(*[r[0] for r in rules if r[1] == rule]), ~readable(v, rule)).otherwise(out)
        return F.coalesce(out, F.lit(True)) & (kind(v) != "null")

    return (kind(body) == "object") & (F.size(F.map_filter(fields(body), refused)) == 0)


def last_values(patches: DataFrame, rules: Rules) -> DataFrame:
    """(key, name, value VARIANT) of patches (key, t, id, body VARIANT): what the accepted patches leave of each known setting.

    A patch sets the fields that it has and deletes those that it has as null, so a setting's last mention decides: a grouping
    by (key, name), in which no document's patches meet."""
    named = patches.where(accepted(F.col("body"), rules)).select("key", "t", "id", F.explode(fields(F.col("body"))).alias("name", "value"))
    known = named.where(F.col("name").isin(*[r[0] for r in rules]))
    last = known.groupBy("key", "name").agg(F.max_by(F.struct("value"), F.struct("t", "id")).alias("last"))
    return last.select("key", "name", F.col("last.value").alias("value")).where(kind(F.col("value")) != "null")


def checked(values: DataFrame, rules: Rules) -> DataFrame:
    """(key, name, number, flag, text, spans) of last_values(): coerced and clamped by each setting's rule."""
    v = F.col("value")
    told = values.select("key", "name", "value", kind(v).alias("kind"), number(v).alias("x"), whole(v).cast("double").alias("w"), truthy(v).alias("yes"), is_false(v).alias("no"))
    x, none = F.col("x"), F.lit(None)
    columns: dict[str, Column] = {"number": none.cast("double"), "flag": none.cast("boolean"), "text": none.cast("string"), "spans": none.cast("array<array<double>>")}
    for setting, rule, low, high, digits in rules:
        here = F.col("name") == setting
        if rule == "number":
            columns["number"] = F.when(here, F.bround(S.clamped(x, low, high), digits)).otherwise(columns["number"])
        elif rule == "whole":
            columns["number"] = F.when(here, S.clamped(F.col("w"), low, high)).otherwise(columns["number"])
        elif rule == "level":  # halves away from zero
            level = S.clamped(x, low, high)
            columns["number"] = F.when(here & ~F.col("no"), F.floor(F.abs(level) + 0.5) * F.signum(level)).otherwise(columns["number"])
            columns["flag"] = F.when(here & F.col("no"), F.lit(False)).otherwise(columns["flag"])
        elif rule == "flag":
            columns["flag"] = F.when(here, F.col("yes")).otherwise(columns["flag"])
        elif rule == "colour":
            shown = F.when(F.col("kind") == "text", read(v, "string")).otherwise(F.to_json(v))
            columns["text"] = F.when(here & shown.rlike(r"\A#[0-9a-fA-F]{6}\z"), F.lower(shown)).otherwise(columns["text"])
        else:
            ends = F.filter(F.transform(elements(v), span_ends), lambda e: F.get(e, 1) > F.get(e, 0))
            rounded = F.transform(ends, lambda e: F.transform(e, lambda y: F.bround(y, digits)))
            columns["spans"] = F.when(here, F.slice(rounded, 1, MOST_SPANS)).otherwise(columns["spans"])
    return told.select("key", "name", *[c.alias(n) for n, c in columns.items()])


def merged(base: Column, patch: Column) -> Column:
    """An object with a patch laid over it, whose null fields delete."""
    own, new = fields(base), fields(patch)
    left = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(new), k))
    return F.to_variant_object(F.map_concat(left, F.map_filter(new, lambda _, v: kind(v) != "null")))


# ---------------------------------------------------------------- colours

#: A picture's settings (name, usual, low, high), and what each preset adds to them at full strength.
COLOURS = (
    ("temperature", 0.0, -100.0, 100.0),
    ("teinte", 0.0, -100.0, 100.0),
    ("exposition", 0.0, -3.0, 3.0),
    ("contraste", 0.0, -100.0, 100.0),
    ("hautes", 0.0, -100.0, 100.0),
    ("ombres", 0.0, -100.0, 100.0),
    ("blancs", 0.0, -100.0, 100.0),
    ("noirs", 0.0, -100.0, 100.0),
    ("saturation", 100.0, 0.0, 200.0),
    ("vibrance", 0.0, -100.0, 100.0),
    ("intensite", 100.0, 0.0, 100.0),
    ("vignette", 0.0, 0.0, 100.0),
)
PRESETS = {
    "chaud": {"temperature": 30.0, "saturation": 6.0, "ombres": 5.0},
    "froid": {"temperature": -30.0, "teinte": -6.0},
    "cinema": {"contraste": 18.0, "saturation": -4.0, "hautes": -8.0},
    "vintage": {"noirs": 30.0, "blancs": -12.0, "saturation": -22.0, "temperature": 18.0},
    "delave": {"noirs": 35.0, "contraste": -18.0, "saturation": -15.0},
    "vif": {"vibrance": 45.0, "contraste": 10.0, "saturation": 8.0},
    "nb": {"saturation": -100.0, "contraste": 28.0, "noirs": -10.0},
    "nuit": {"exposition": -0.9, "temperature": -45.0, "saturation": -30.0, "contraste": 10.0},
}
TRANSITIONS = ("fondu", "fondunoir", "fondublanc", "fonduflou", "fonduadditif", "fondufilm", "balayage", "balayagedoux", "volets", "horloge", "iris", "losange", "ouverture", "poussee", "glissement", "etirement", "fouet", "zoomcroise", "flash", "seisme", "glitch", "retournement", "tele")
SHORTEST, LONGEST, USUAL = 0.2, 1.5, 0.5


def finite(v: Column) -> Column:
    """A number, or a text that tells one, if it is finite; a boolean isn't one here."""
    x = F.when(kind(v).isin("number", "text"), number(v))
    return F.when((F.abs(x) < float("inf")) & ~F.isnan(x), x)


def preset_of(name: Column) -> Column:
    return F.when(name.isin(*PRESETS), name).otherwise(F.lit(""))


def added_by(preset: Column, setting: str) -> Column:
    """What a preset adds to a setting at full strength."""
    out = F.lit(0.0)
    for name, adds in PRESETS.items():
        if setting in adds:
            out = F.when(preset == name, F.lit(adds[setting])).otherwise(out)
    return out


def colours(docs: DataFrame, doc: str) -> DataFrame:
    """With a struct `colours` of a document's settings and its preset `look`, usual values for what it lacks. A document that
    doesn't say version 2 has sliders without the preset, which is then added (saturation is multiplied). Unrounded."""
    told = docs.withColumn("_fields", fields(F.col(doc)))
    field = lambda name: F.try_element_at("_fields", name)
    names = F.array(*[F.lit(name) for name, *_ in COLOURS])
    look, version = field(F.lit("look")), field(F.lit("v"))
    told = told.withColumns({
        "_raw": F.transform(names, lambda n: finite(field(n))),
        "_look": preset_of(F.when(kind(look) == "text", read(look, "string")).otherwise(F.lit(""))),
        "_old": ~F.coalesce((kind(version) == "number") & (read(version, "double") == 2), F.lit(False)),
    })
    place = {name: k for k, (name, *_) in enumerate(COLOURS)}
    raw = lambda name, usual: F.coalesce(F.get("_raw", place[name]), F.lit(usual))
    told = told.withColumn("_strength", S.clamped(raw("intensite", 100.0), 0.0, 100.0) / 100)
    out = []
    for name, usual, low, high in COLOURS:
        x, adds = raw(name, usual), F.col("_strength") * added_by(F.col("_look"), name)
        if name == "saturation":
            x = F.when(F.col("_old"), x * F.greatest(F.lit(0.0), 1 + adds / 100)).otherwise(x)
        elif name != "intensite":
            x = F.when(F.col("_old"), x + adds).otherwise(x)
        out.append(S.clamped(x, low, high).alias(name))
    return told.withColumn("colours", F.struct(*out, F.col("_look").alias("look"))).drop("_fields", "_raw", "_look", "_old", "_strength")


def with_preset(settings: Column, preset: Column, strength: Column) -> Column:
    """Settings under another preset or strength: what the old one added is taken off, what the new one adds put on, so that
    changes made by hand stay. Unrounded."""
    new, old = preset_of(preset), settings["look"]
    k_new, k_old = S.clamped(strength, 0.0, 100.0) / 100, settings["intensite"] / 100
    out = []
    for name, _, low, high in COLOURS:
        x = settings[name] - k_old * added_by(old, name) + k_new * added_by(new, name)
        out.append((k_new * 100 if name == "intensite" else S.clamped(x, low, high)).alias(name))
    return F.struct(*out, new.alias("look"))


def neutral(settings: Column) -> Column:
    """Whether nothing is changed: no preset, and all but the strength as usual."""
    out = settings["look"] == ""
    for name, usual, *_ in COLOURS:
        if name != "intensite":
            out = out & (settings[name] == usual)
    return out


def transition(v: Column) -> Column:
    """(kind, dur) of a transition, or null where it isn't an object or of no known kind; an empty kind is a plain cut."""
    named = fields(v)
    told, dur = F.try_element_at(named, F.lit("kind")), F.try_element_at(named, F.lit("dur"))
    name = F.when(kind(told) == "text", read(told, "string")).otherwise(F.lit(""))
    known = (kind(v) == "object") & name.isin("", *TRANSITIONS)
    return F.when(known, F.struct(name.alias("kind"), F.bround(S.clamped(F.coalesce(finite(dur), F.lit(USUAL)), SHORTEST, LONGEST), 2).alias("dur")))
