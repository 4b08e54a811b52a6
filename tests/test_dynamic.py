"""Documents of unknown shape: coercions of every type, patches against a plain version, presets, transitions."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import functions as F

from tidemark.operators import dynamic

VALUES = [None, True, False, 0, 3, 3.0, -2.75, "", "3", " 4_0 ", "2.5", "x", "inf", "7/2", [], [3], {}, {"a": 1}]


def plain_number(v):
    if isinstance(v, bool | int | float):
        return float(v)
    if isinstance(v, str):
        try:
            return float(v.strip().replace("_", ""))
        except ValueError:
            return None
    return None


def plain_whole(v):
    if isinstance(v, bool | int | float):
        return int(v)
    if isinstance(v, str):
        try:
            return int(v.strip().replace("_", ""))
        except ValueError:
            return None
    return None


def documents(spark, values):
    rows = [(k, None if v is None and k % 2 else json.dumps(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, doc string").withColumn("doc", F.parse_json("doc"))


def test_coercions(spark):
    d = F.col("doc")
    got = documents(spark, VALUES).select("id", dynamic.truthy(d).alias("t"), dynamic.number(d).alias("n"), dynamic.whole(d).alias("w"), dynamic.same_id(d, F.lit(3)).alias("s"), dynamic.is_number(d).alias("i"))
    for r in got.collect():
        v = VALUES[r["id"]]
        assert (r["t"], r["n"], r["w"]) == (bool(v), plain_number(v), plain_whole(v)), v
        assert r["s"] == (not isinstance(v, str) and v == 3) and r["i"] == isinstance(v, bool | int | float)


def test_lists_of_ids(spark):
    docs = documents(spark, [[3], [3.0], [True], ["3"], ["3/1"], ["33/1"], [None, {}, "1/9"], {"3": 3}, 3])
    got = {r["id"]: (r["has3"], r["kept3"], r["kept1"]) for r in docs.select("id", dynamic.contains(F.col("doc"), F.lit(3)).alias("has3"), dynamic.kept(F.col("doc"), F.lit(3)).alias("kept3"), dynamic.kept(F.col("doc"), F.lit(1)).alias("kept1")).collect()}
    assert got == {0: (True, True, False), 1: (True, True, False), 2: (False, False, True), 3: (False, True, False), 4: (False, True, False), 5: (False, False, False), 6: (False, False, True), 7: (False, False, False), 8: (False, False, False)}


def test_merge_and_either(spark):
    df = spark.createDataFrame([('{"a": 1, "b": [2]}', '{"b": null, "c": {"x": 1}}'), ("[1]", '{"a": 1}'), (None, None)], "a string, b string").select(F.parse_json("a").alias("a"), F.parse_json("b").alias("b"))
    got = [tuple(json.loads(x) if x else None for x in r) for r in df.select(F.to_json(dynamic.merged(F.col("a"), F.col("b"))), F.to_json(dynamic.either(F.col("a"), F.col("b")))).collect()]
    assert got == [({"a": 1, "c": {"x": 1}}, {"a": 1, "b": [2]}), ({"a": 1}, [1]), ({}, None)]


def plain_patches(bodies):
    """Settings of one document after its bodies, in order."""
    out: dict = {}
    for body in bodies:
        if not isinstance(body, dict):
            continue
        readable = {
            "voice": lambda v: plain_number(v) is not None,
            "denoise": lambda v: plain_whole(v) is not None,
            "loudness": lambda v: v is False or plain_number(v) is not None,
            "mute": lambda v: isinstance(v, list) and all(isinstance(p, list) and len(p) == 2 and all(plain_number(x) is not None for x in p) for p in v),
        }
        if not all(v is None or readable.get(k, lambda _: True)(v) for k, v in body.items()):
            continue
        for k, v in body.items():
            if v is None:
                out.pop(k, None)
            elif k == "voice":
                out[k] = round(min(2.0, max(0.0, plain_number(v))), 2)
            elif k == "denoise":
                out[k] = float(min(3, max(0, plain_whole(v))))
            elif k == "loudness":
                x = None if v is False else min(-8.0, max(-30.0, plain_number(v)))
                out[k] = False if x is None else math.copysign(math.floor(abs(x) + 0.5), x)
            elif k == "clarity":
                out[k] = bool(v)
            elif k == "mute":
                out[k] = [[round(plain_number(a), 2), round(plain_number(b), 2)] for a, b in v if plain_number(b) > plain_number(a)]
    return out


def test_patches(spark):
    rng = random.Random(4)
    choices = {
        "voice": [1, 0.5, "1.25", True, None, 9, "x", [1]],
        "denoise": [1, 2.9, "3", "2.5", None, -4],
        "loudness": [False, True, -12.5, "-11.5", None, -99],
        "clarity": [0, 1, "", "no", [], None],
        "mute": [[], [[1, 2.126], ["3", 2]], [[1]], "no", None, [[0, True]]],
        "other": [1, None],
    }
    rows, plain = [], {}
    for k in range(60):
        bodies = []
        for t in range(rng.randrange(1, 7)):
            body = {n: rng.choice(v) for n, v in choices.items() if rng.random() < 0.5} if rng.random() < 0.9 else rng.choice([None, [1], "x"])
            bodies.append(body)
            rows.append((k, t, t, json.dumps(body)))
        plain[k] = plain_patches(bodies)
    rows.append((None, 1, 1, None))
    df = spark.createDataFrame(rows, "key long, t long, id long, body string").withColumn("body", F.parse_json("body")).repartition(5)
    got: dict = {k: {} for k in plain}
    for r in dynamic.checked(dynamic.last_values(df, dynamic.SOUND), dynamic.SOUND).collect():
        got[r["key"]][r["name"]] = r["number"] if r["number"] is not None else r["spans"] if r["name"] == "mute" else r["flag"]
    assert got == plain


def test_overlay_colour(spark):
    df = spark.createDataFrame([(1, 1, 1, '{"karaokeColor": "#FFaa00", "pop": 1}'), (2, 1, 1, '{"karaokeColor": "#FFaa0"}')], "key long, t long, id long, body string").withColumn("body", F.parse_json("body"))
    got = {(r["key"], r["name"]): (r["text"], r["flag"]) for r in dynamic.checked(dynamic.last_values(df, dynamic.OVERLAY), dynamic.OVERLAY).collect()}
    assert got == {(1, "karaokeColor"): ("#ffaa00", None), (1, "pop"): (None, True), (2, "karaokeColor"): (None, None)}


def test_presets_keep_changes_by_hand(spark):
    docs = documents(spark, [{"v": 2, "look": "vif", "contraste": 35, "vibrance": 45, "saturation": 108}, {"v": 2, "intensite": 50}, {"look": "none", "exposition": "x"}, None])
    told = dynamic.colours(docs, "doc").withColumn("then", dynamic.with_preset(F.col("colours"), F.lit("nb"), F.lit(50.0))).withColumn("off", dynamic.with_preset(F.col("colours"), F.lit(""), F.lit(100.0)))
    got = {r["id"]: r for r in told.withColumn("neutral", dynamic.neutral(F.col("colours"))).collect()}
    assert (got[0]["off"]["contraste"], got[0]["off"]["vibrance"], got[0]["off"]["saturation"], got[0]["off"]["look"]) == (25.0, 0.0, 100.0, "")
    assert (got[0]["then"]["contraste"], got[0]["then"]["saturation"], got[0]["then"]["intensite"]) == (39.0, 50.0, 50.0)
    assert [got[k]["neutral"] for k in range(4)] == [False, True, True, True]


def test_transitions(spark):
    docs = documents(spark, [{"kind": "iris", "dur": 9}, {"kind": 5, "dur": "0.777"}, {"kind": "unknown"}, [1], {}, {"dur": "inf"}])
    got = {r["id"]: r["x"] and tuple(r["x"]) for r in docs.select("id", dynamic.transition(F.col("doc")).alias("x")).collect()}
    assert got == {0: ("iris", 1.5), 1: ("", 0.78), 2: None, 3: None, 4: ("", 0.5), 5: ("", 0.5)}
