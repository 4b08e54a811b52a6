"""Literal cases of single operators, plain versions of those that SQL doesn't express, and empty or null input."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import align, asof, cost, docs, folds, intervals, islands, series, text, timeline, vectors

IV = "key long, id long, s long, e long"
PT = "key long, id long, t long, cents long"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_gaps_and_merge(spark):
    iv = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 5, 20), (1, 3, 30, 40), (1, 4, 40, 45)], IV)
    assert rows(intervals.gaps(iv, 5)) == [(1, 1000, 20, 30)]
    assert rows(intervals.gaps_head_tail(iv, -10, 100, 5)) == [(1, 1000, -10, 0), (1, 1001, 20, 30), (1, 1002, 45, 100)]
    assert rows(intervals.merged(iv), "s", "e", "n") == [(0, 20, 2), (30, 45, 2)]
    assert rows(intervals.merged(iv, 5), "s", "e") == [(-5, 50)]
    assert rows(intervals.covered(iv)) == [(1, 35)]
    assert rows(intervals.offset_lookup(iv), "id", "offset") == [(1, 0), (2, 5), (3, 20), (4, 30)]


def test_overlaps_across_bins(spark):
    a = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 95, 130)], IV)
    b = spark.createDataFrame([(1, 7, 90, 110), (1, 8, 129, 300), (2, 9, 0, 100)], IV)
    for width in (7, 50, 1000):
        assert rows(intervals.overlaps_clipped(a, b, width)) == [(1, 1, 7, 90, 100), (1, 2, 7, 95, 110), (1, 2, 8, 129, 130)]
    assert rows(intervals.most_overlapping(a, b, 10)) == [(1, 1, 7, 10), (1, 2, 7, 15)]


def test_not_contained(spark):
    iv = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 0, 10), (1, 3, 2, 9), (1, 4, 5, 12)], IV)
    assert rows(intervals.not_contained(iv), "id") == [(1,), (4,)]


def test_asof(spark):
    left = spark.createDataFrame([(1, 1, 10), (1, 2, 25), (2, 3, 5)], "key long, id long, t long")
    right = spark.createDataFrame([(1, 7, 8), (1, 8, 12), (1, 9, 25)], "key long, id long, t long")
    assert {r["id"]: r["match_id"] for r in asof.backward(left, right).collect()} == {1: 7, 2: 9, 3: None}
    assert {r["id"]: r["match_id"] for r in asof.nearest(left, right).collect()} == {1: 7, 2: 9, 3: None}
    assert {r["id"]: r["match_id"] for r in asof.nearest(left, right, within=1).collect()} == {1: None, 2: 9, 3: None}


def test_pause_is_inclusive(spark):
    p = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 9, 0), (1, 3, 19, 0)], PT)
    assert rows(islands.pause_chunks(p, 10), "s", "e") == [(0, 9), (19, 19)]


def test_capped_chunks(spark):
    p = spark.createDataFrame([(1, k, t, 0) for k, t in enumerate((0, 3, 6, 9, 30, 31))], PT)
    assert rows(folds.capped_chunks(p, 10, 5), "s", "e", "n") == [(0, 3, 2), (6, 9, 2), (30, 31, 2)]


def test_held_turns(spark):
    runs = spark.createDataFrame([(1, 1, "A", 0, 3), (1, 2, "B", 3, 1), (1, 3, "A", 4, 2), (1, 4, "B", 6, 3)], "key long, run long, spk string, s long, n long")
    assert rows(folds.held_turns(runs, 2), "spk", "s", "e") == [("A", 0.0, 6.0), ("B", 6.0, math.inf)]
    short_first = spark.createDataFrame([(1, 1, "B", 0, 1), (1, 2, "A", 1, 3)], "key long, run long, spk string, s long, n long")
    assert rows(folds.held_turns(short_first, 2), "spk", "s", "e") == [("A", 0.0, math.inf)]


def test_spaced_and_packed(spark):
    p = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 50, 0)], PT)
    assert rows(folds.spaced(p, 10), "at") == [(0,), (10,), (50,)]
    iv = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 5, 10), (1, 3, 10, 15)], IV)
    assert rows(folds.packed(iv, 11, 1), "id", "bin") == [(1, 1), (2, 1), (3, 2)]


def test_refractory_and_strongest(spark):
    e = spark.createDataFrame([(1, 1, 0), (1, 2, 5), (1, 3, 9), (1, 4, 12)], "key long, id long, t long")
    assert rows(folds.refractory(e, 8), "id") == [(1,), (3,)]
    s = e.withColumn("strength", F.col("id") * 10)
    assert rows(folds.strongest_apart(s, 8), "id") == [(1,), (4,)] or rows(folds.strongest_apart(s, 8), "id") == [(2,), (4,)]
    kept = rows(folds.strongest_apart(s, 8), "t")
    assert all(b[0] - a[0] >= 8 for a, b in zip(kept, kept[1:]))


def test_onsets_plain_version(spark):
    values = [10, 12, 11, 90, 80, 12, 11, 10, 95, 11]
    p = spark.createDataFrame([(1, k, 10 * k, v) for k, v in enumerate(values)], PT)
    got = rows(series.onsets(p, "cents", 4, 5, 25, trailing=3), "id")
    hot = [k for k, v in enumerate(values) if k and v > 4 * sorted(values[max(0, k - 3) : k])[len(values[max(0, k - 3) : k]) // 2]]
    kept, last = [], None
    for k in hot:
        if last is None or 10 * k - last >= 25:
            kept.append((k,))
            last = 10 * k
    assert got == kept


def test_interpolation_keeps_out_of_holes(spark):
    p = spark.createDataFrame([(1, 1, 0, 0), (1, 2, 40, 40), (1, 3, 100, 100)], PT)
    assert rows(series.interpolated(p, "cents", 10, 50), "g", "v") == [(g, float(g)) for g in (0, 10, 20, 30, 40, 100)]
    assert rows(series.nearest_filled(p, "cents", 50), "g", "v") == [(0, 0), (50, 40), (100, 100)]


@pytest.mark.parametrize(("word", "form", "stem"), [("« Élèves, »", "élèves", "eleve"), ("L’été!", "l'été", "l'ete"), ("pas", "pas", "pas"), ("…", "", "")])
def test_word_forms(spark, word, form, stem):
    got = spark.createDataFrame([(word,)], "w string").select(S.word_form("w").alias("f"), S.stem("w").alias("s")).first()
    assert (got["f"], got["s"]) == (form, stem)


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(S.stamp(F.lit(3_725_500))).first()[0] == "01:02:05,500"
    assert one.select(S.round_exact(F.lit(2.675), F.lit(2)), S.round_exact(F.lit(0.125), F.lit(2))).first()[:] == (2.67, 0.12)
    assert one.select(S.shortest(F.lit(12345678.5)), S.shortest(F.lit(0.00012))).first()[:] == ("12345678.5", "0.00012")
    assert one.select(S.gcd(F.lit(1920), F.lit(1080))).first()[0] == 120
    assert one.select(S.limited_fraction(F.lit(29.97002997), F.lit(1001)).alias("f")).first()["f"][:] == (30000, 1001)
    assert one.select(S.display_name(F.lit("\tlate \n show/cut 2 "))).first()[0] == "late show cut 2"
    assert one.select(S.file_safe(F.lit("Göteborg/2?part*a"))).first()[0] == "Göteborg_2_part_a"
    assert one.select(S.as_long(F.lit("3.5")), S.as_long(F.lit(" 12 ")), S.as_double(F.lit("x"), -1.0)).first()[:] == (None, 12, -1.0)
    assert one.select(S.version_parts(F.lit("v1.10.2"))).first()[0] == [1, 10, 2]
    assert one.select(S.loudness(F.lit(0.0))).first()[0] == -math.inf
    assert abs(one.select(S.hertz(S.mel(F.lit(4321.0)))).first()[0] - 4321.0) < 1e-6


def test_sentence_ends(spark):
    e = spark.createDataFrame([("fin.",), ("bon...",), ("oui? ",), ("non",)], "w string")
    assert [r[0] for r in e.select(S.ends_sentence("w")).collect()] == [True, False, True, False]


def test_foreign_texts(spark):
    t = spark.createDataFrame([(1, "fr", "Le vent du nord et la mer"), (2, "fr", "the wind of l'est and the sea"), (3, "de", "der Wind"), (4, "en", "the ветер"), (5, None, "le la les"), (6, "fr", None)], "key long, lang string, text string")
    got = {r["key"]: (r["own"], r["other"], r["foreign"]) for r in text.foreign_texts(t).collect()}
    assert got == {1: (4, 0, False), 2: (0, 4, True), 3: (0, 0, False), 4: (1, 0, True), 5: (0, 3, True), 6: (0, 0, False)}


def test_captions(spark):
    ws = "Le port, vu d'ici, dort. Demain les grands bateaux repartiront lentement vers le large... Voilà tout".split()
    n = len(ws)
    spoken = spark.createDataFrame([(1, ws, [300 * k for k in range(n)], [300 * k + 300 for k in range(n)], [0] * n), (2, ["un", "", "deux", None, "trois"], [0, 0, 300, 0, 2000], [300, 0, 600, 0, 2300], [0, 0, 0, 0, 0]), (3, None, None, None, None), (4, ["a", "b"], [0, 1], [1, 2], [0, 1])], "key long, words array<string>, start array<long>, end array<long>, moment array<long>")
    got = {}
    for r in timeline.captions(spoken).orderBy("key", "caption").collect():
        got.setdefault(r["key"], []).append((r["text"], r["split"]))
    # a comma ends one from three words on; the word that passes the letters stays; dots end a caption
    assert got[1] == [("Le port, vu d'ici,", 2), ("dort.", 0), ("Demain les grands bateaux repartiront", 3), ("lentement vers le large...", 2), ("Voilà tout", 1)]
    assert got[2] == [("un deux", 1), ("trois", 0)] and got[4] == [("a", 0), ("b", 0)] and set(got) == {1, 2, 4}
    assert rows(timeline.captions(spoken).where("key = 2"), "caption", "n", "start", "end") == [(0, 2, 0, 600), (1, 1, 2000, 2300)]


def test_cues(spark):
    caps = spark.createDataFrame([(1, 1, 0, 300, "a"), (1, 2, 300, 600, " "), (1, 3, 1400, 2900, "b")], "key long, caption long, start long, end long, text string")
    assert rows(timeline.cues(caps), "n", "start", "end", "text") == [(1, 0, 1400, "a"), (2, 1400, 4100, "b")]


def test_balanced_split(spark):
    df = spark.createDataFrame([(["Lanterne", "et", "mer"],), (["un"],)], "w array<string>")
    assert [r[0] for r in df.select(text.balanced_split(F.col("w"))).collect()] == [1, 0]


def test_alignment(spark):
    pairs = spark.createDataFrame([(1, 1, list("abxcd"), list("abcd"))], "key long, i long, a array<string>, b array<string>")
    ops = [(r["tag"], r["i1"], r["i2"], r["j1"], r["j2"]) for r in align.opcodes(pairs).orderBy("n").collect()]
    assert ops == [("equal", 0, 2, 0, 2), ("delete", 2, 3, 2, 2), ("equal", 3, 5, 2, 4)]
    assert abs(pairs.select(align.ratio("a", "b")).first()[0] - 8 / 9) < 1e-12
    assert align.realigned("salut la mer".split(), "Salut, mer du nord".split()) == ["Salut,", "", "mer du nord"]
    assert align.realigned("un, deux trois".split(), "un deux deux trois".split()) == ["un", "deux deux", "trois"]
    assert align.realigned(["mer"], "la belle mer".split()) == ["la belle mer"]


def test_most_overlapping(spark):
    a = spark.createDataFrame([(1, 1, 0, 100), (1, 2, 5000, 5010), (2, 3, 0, 10)], IV)
    b = spark.createDataFrame([(1, 10, 90, 110), (1, 11, 95, 1_000_000), (1, 12, 60, 80), (1, 13, 60, 80), (1, 14, 6000, 6002)], IV)
    # 12 and 13 share as much and are nearer than 10; without common time the nearest middle counts
    assert rows(intervals.most_overlapping(a, b, 50), "a_id", "b_id", "shared") == [(1, 13, 20), (2, 14, 0)]
    assert intervals.most_overlapping(a.limit(0), b, 50).count() == 0


def test_spikes_rise_over_their_neighbours(spark):
    values = [0] * 10 + [50, 60] + [0] * 10 + [40, 55, 40] + [0, 0, 0, 50] + [0] * 8
    p = spark.createDataFrame([(1, k, k, v) for k, v in enumerate(values)], "key long, id long, t long, v long")
    assert rows(series.spikes(p, "v", 30, 3), "t") == [(11,), (23,), (28,)]
    # what lies four rows after the second run's end is nearly as high
    assert rows(series.spikes(p, "v", 30, 3, rise=12), "t") == [(11,)]


def test_state_operators(spark):
    s = spark.createDataFrame([(1, 1, 5, "a", "x"), (1, 2, 5, "a", "y"), (1, 3, 1, "b", None)], "key long, id long, t long, kind string, k string")
    assert rows(docs.latest(s, ["key", "kind"]), "kind", "id") == [("a", 2), ("b", 3)]
    assert docs.fingerprint(s).count() == 1
    before = spark.createDataFrame([(1, "a", "x"), (1, "c", "z")], "key long, kind string, k string")
    after = spark.createDataFrame([(1, "a", "y"), (1, "b", None)], "key long, kind string, k string")
    assert [(r["kind"], r["old"], r["new"]) for r in docs.difference(before, after, ["key", "kind"]).collect()] == [("a", "x", "y")]
    assert rows(docs.patch_rows(before, after, ["key", "kind"]), "kind", "k") == [("a", "y"), ("c", "z")]
    m = spark.range(1).select(docs.patched(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))).alias("m")).first()["m"]
    assert m == {"b": "2", "c": "3"}


def test_split_then_join_gives_the_parts_back(spark):
    parts = spark.createDataFrame([(1, 0, 100), (1, 200, 300), (2, 0, 50)], "key long, s long, e long")
    cuts = spark.createDataFrame([(1, 40), (1, 250), (1, 150), (2, 50)], "key long, t long")
    split = docs.split_part(parts, cuts)
    assert rows(split) == [(1, 0, 40), (1, 40, 100), (1, 200, 250), (1, 250, 300), (2, 0, 50)]
    assert rows(docs.joined_parts(split)) == rows(parts)


def test_leaders_and_links(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.9, 0.1]), (3, 0, [0.0, 1.0]), (4, 0, None)], "id long, label int, embedding array<double>")
    assert rows(vectors.similar_pairs(v, 0.9), "i", "j") == [(1, 2)]
    r = v.selectExpr("cast(label as long) as key", "id", "1 as n", "embedding")
    assert rows(vectors.average_link(r, 0.5), "id", "cluster") == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert vectors.average_link(r.limit(0), 0.5).count() == 0 and vectors.leader_clusters(r.limit(0), 0.5).count() == 0


def test_too_large_a_group_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(vectors, "MOST_ROWS", 2)
    r = spark.createDataFrame([(1, k, [1.0 * k]) for k in range(3)], "key long, id long, embedding array<double>")
    with pytest.raises(Exception, match="a group of 3 rows"):
        vectors.average_link(r, 0.5).collect()


def test_leaders_plain_version(spark):
    rng = np.random.default_rng(5)
    v = [(1, k, int(rng.integers(1, 6)), rng.normal(size=3).tolist()) for k in range(60)]
    groups = []
    for _, k, n, x in sorted(v, key=lambda r: (-r[2], r[1])):
        x = np.array(x) / np.linalg.norm(x)
        sims = [float(x @ g[1] / np.linalg.norm(g[1])) for g in groups]
        best = max(range(len(groups)), key=lambda g: (sims[g], g), default=None)
        if best is not None and sims[best] >= 0.6:
            groups[best] = (groups[best][0] + [k], groups[best][1] + n * x)
        else:
            groups.append(([k], n * x))
    of = {k: g[0][0] for g in groups for k in g[0]}
    seen = {k: n for _, k, n, _ in v}
    order = sorted(groups, key=lambda g: (-sum(seen[k] for k in g[0]), -seen[g[0][0]], g[0][0]))
    person = {k: 1 + p for p, g in enumerate(order) for k in g[0]}
    got = vectors.leader_clusters(spark.createDataFrame([*v, (1, 99, 3, None)], "key long, id long, n int, embedding array<double>"), 0.6).where("id < 99").collect()
    assert {r["id"]: r["cluster"] for r in got} == of
    ranks = {r["id"]: r["person"] for r in got}
    assert sorted(ranks, key=lambda k: (ranks[k], k)) == sorted(person, key=lambda k: (person[k], k))


def test_costs(spark):
    seen = spark.createDataFrame([(1, t, t, 100 * t, 100) for t in range(1, 8)], "key long, t long, id long, peak long, model long")
    assert rows(cost.learned_factor(seen)) == [(1, 3000, 5)]
    needs = spark.createDataFrame([(1, 1000, 100, 100), (2, 10, 100, 100)], "key long, free long, fixed long, each long")
    assert rows(cost.most_workers(needs, 8)) == [(1, 7), (2, 1)]
    assert rows(cost.verdicts(needs), "key", "verdict") == [(1, "ok"), (2, "insufficient")]


def test_empty_tables(spark):
    iv, p = spark.createDataFrame([], IV), spark.createDataFrame([], PT)
    for df in (intervals.gaps(iv, 1), intervals.merged(iv), intervals.overlaps(iv, iv, 5), intervals.not_contained(iv), asof.nearest(p, p), islands.pause_chunks(p, 1), folds.capped_chunks(p, 1, 1), folds.packed(iv, 1, 1), series.interpolated(p, "cents", 1, 1), series.onsets(p, "cents", 4, 5, 5)):
        assert df.count() == 0


def test_frames(spark):
    from tidemark.functions import frames

    f = spark.createDataFrame([(1920, 1080), (1918, 1080), (1000, 300), (0, 5), (None, 5)], "w long, h long")
    assert [r[0] for r in f.select(frames.ratio_name(F.col("w"), F.col("h"))).collect()] == ["16:9", "16:9", "10:3", "?", None]
    assert [tuple(r[0]) for r in f.limit(3).select(frames.fit_inside(F.col("w"), F.col("h"), 1080, 1920)).collect()] == [(1080, 608), (1080, 608), (1080, 324)]
    assert [tuple(r[0]) for r in f.limit(3).select(frames.work_size(F.col("w"), F.col("h"), 1080)).collect()] == [(1920, 1080), (1920, 1080), (3600, 1080)]
    one = spark.range(1)
    box = frames.margin_box(F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.2), F.lit(False))
    assert [round(x, 9) for x in one.select(box).first()[0]] == [0.35, 0.34, 0.65, 0.68]
    assert abs(one.select(frames.widest_zoom(F.lit(0.5), F.lit(0.5), box, 3.0)).first()[0] - 0.5 / 0.18) < 1e-9
    whole = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(1.0).alias("y1"))
    assert one.select(frames.widest_zoom(F.lit(0.5), F.lit(0.5), whole, 3.0)).first()[0] == 1.0
    assert one.select(frames.same_ratio(F.lit(1921), F.lit(1080), F.lit(16), F.lit(9)), frames.same_ratio(F.lit(4), F.lit(3), F.lit(16), F.lit(9))).first()[:] == (True, False)
    assert one.select(frames.iso_time(F.lit(-1)), frames.iso_time(F.lit(86_400_000_000)), frames.trimmed(F.lit(2.5)), frames.trimmed(F.lit(3.0))).first()[:] == ("1969-12-31T23:59:59.999999+00:00", "1970-01-02T00:00:00+00:00", "2.5", "3")


def test_clips(spark):
    c = spark.createDataFrame([(1, 1, None, 30, 60), (1, 2, None, 90, 30), (1, 3, 300, 0, 30), (1, 4, None, 5, 0), (1, 5, None, 60, 30), (1, 6, None, None, 30)], "key long, i long, at long, source long, length long")
    assert rows(timeline.clip_times(c), "i", "at", "source", "lasting") == [(1, 0.0, 1.0, 2.0), (2, 2.0, 3.0, 1.0), (3, 10.0, 0.0, 1.0), (5, 11.0, 2.0, 1.0)]
    cut = spark.createDataFrame([(1, 100, 200, 140), (1, 0, 5, 3), (1, None, 5, 3)], "key long, at long, length long, source long")
    assert rows(timeline.cut_points(cut, 150), "at", "source", "start") == [(0, 3, True), (100, 140, True), (110, 150, False), (260, 300, False)]
    e = spark.createDataFrame([(1, 1, 50), (1, 2, None), (1, 3, 10)], "key long, id long, at long")
    assert rows(timeline.shifted(e, -20, 0, 40), "id", "at") == [(2, 0), (3, 0)]
    near = timeline.nearest_rows(spark.createDataFrame([(1, 5), (1, 0), (2, 1)], "key long, i long"), spark.createDataFrame([(1, 1), (1, 4), (1, 6), (1, 9)], "key long, i long"))
    assert rows(near) == [(1, 0, 1), (1, 0, 4), (1, 5, 4), (1, 5, 6)]


def test_second_listening(spark):
    from tidemark.operators import listen

    own = spark.createDataFrame([("lampe", 0.01), ("mer", 0.02), ("garde", 0.01), ("fou", 0.01), ("light", 0.0001)], "word string, share double")
    other = spark.createDataFrame([("light", 0.02), ("sea", 0.03), ("mer", 0.00001)], "word string, share double")
    cases = {"Lampe,": "known", "l'Œuvre": "unknown", "L'œuvre": "name", "d’lampe": "known", "light": "foreign", "sea-light": "foreign", "garde-fou": "known", "sea-xyz": "unknown", "sea'xyz": "foreign", "Xyz": "name", "x9": "known", "...": "known", "euh": "known", "ouais": "known", "": "known"}
    words = spark.createDataFrame([(1, k // 4, k, w, 0.3 if w == "Lampe," else None) for k, w in enumerate(cases)], "key long, segment long, i long, w string, p double")
    kinds = listen.word_kinds(words, own, other, "fr")
    assert {r["w"]: r["kind"] for r in kinds.collect()} == cases
    assert {(r["w"], r["reason"]) for r in listen.suspects(words, kinds).collect()} == {("Lampe,", "confidence"), ("l'Œuvre", "unknown"), ("light", "other language"), ("sea-light", "other language"), ("sea-xyz", "unknown"), ("sea'xyz", "other language")}
    assert {r["segment"] for r in listen.mostly_foreign(words, kinds).collect()} == {1}
    df = spark.createDataFrame([(["mer", "Mer!", "mer"], 5), (list("abcdef"), 1), (list("abcde"), 1), (None, 1)], "t array<string>, n int")
    assert [r[0] for r in df.select(listen.invented(F.col("t"), F.col("n"))).collect()] == [True, True, False, False]
    assert listen.word_kinds(words.limit(0), own, other, "fr").count() == 0


def test_folds_take_rows_without_a_time(spark):
    p = spark.createDataFrame([(1, 1, None, 5), (1, 2, 0, 5), (1, 3, 0, None), (1, 4, 1, 7), (None, 5, 3, 1), (1, 2, 0, 5)], PT)
    s = p.withColumn("strength", F.col("cents"))
    assert rows(folds.capped_chunks(p.where("key = 1"), 10, 100), "chunk", "n") == [(0, 4)]
    assert rows(folds.spaced(p.where("key = 1"), 3), "t", "at") == [(0, 0), (0, 3), (0, 6), (1, 9)]
    assert folds.spaced(p, 3).count() == 5 and folds.ewma(p, "cents").count() == 4
    assert folds.content_chunks(p, 1, 10).agg(F.sum("n")).first()[0] == 5
    assert rows(folds.refractory(p.where("key = 1").select("key", "t", "id"), 1), "t") == [(0,), (1,)]
    assert rows(folds.strongest_apart(s.where("key = 1").select("key", "t", "id", "strength"), 1), "t", "strength") == [(0, 5), (1, 7)]
    iv = spark.createDataFrame([(1, 1, 0, None), (1, 2, None, 4), (1, 3, 0, 4), (1, 4, 5, 7)], IV)
    assert rows(folds.packed(iv, 7, 1), "id", "bin") == [(3, 1), (4, 1)]


def test_clamped_settings(spark):
    r = spark.createDataFrame([(1, "gain", 9.0), (1, "cut", None), (2, "gain", 0.5)], "key long, name string, value double")
    b = spark.createDataFrame([("gain", 0.0, 3.0, 1.0), ("cut", -1.0, 1.0, 0.0)], "name string, low double, high double, usual double")
    assert rows(docs.clamped_settings(r, b)) == [(1, "cut", 0.0), (1, "gain", 3.0), (2, "cut", 0.0), (2, "gain", 0.5)]
    assert docs.clamped_settings(r, b.limit(0)).count() == 0 and docs.clamped_settings(r.limit(0), b).count() == 0


def test_progress_numbers_with_exponents(spark):
    from tidemark.streaming import telemetry

    df = spark.createDataFrame([(1, "2024-01-01", line) for line in ("@progression 1.5e+06 2e+06 a b", "@progression 1 0 c", "@progression 1-2 3 d", "x")], "key long, ts string, line string")
    assert rows(telemetry.progress_lines(df), "done", "total", "label") == [(1_500_000.0, 2_000_000.0, "a b")]


def test_quantiles_as_engines_interpolate(spark):
    rows = [(1, k, v, "a" if k % 3 else "view") for k, v in enumerate([5, 1, 1, None, 10, 2, 7])] + [(2, 1, None, "a"), (None, 1, 4, None)]
    p = spark.createDataFrame(rows, "key long, id long, cents long, kind string")
    got = {r["key"]: tuple(r)[1:] for r in series.quantiles(p, "cents", {"q": (F.col("kind") != "view", 0.3), "any": (F.lit(True), 0.1)}).collect()}
    # rows without values are counted but have no rank
    assert got == {1: (1.0, 4, 1.0, 7), 2: (None, 1, None, 1), None: (None, 0, 4.0, 1)}


def test_percentile_floor_on_its_bounds(spark, tmp_path):
    import datetime

    import duckdb

    from tidemark.plans import catalogue

    # quantiles that are a bound of the levels but for their last bit, which depends on how they are interpolated
    cases = [(n, low, bound, low + (bound - low) * 10 // (3 * (n - 1) % 10)) for n in range(22, 60) if 3 * (n - 1) % 10 for bound in (2500, 5000) for low in range(bound - 300, bound, 3) if (bound - low) * 10 % (3 * (n - 1) % 10) == 0]
    at, rows = datetime.datetime(2024, 1, 1), []
    for key, (n, low, _, high) in enumerate(cases):
        k = 3 * (n - 1) // 10
        rows += [(len(rows) + x, at, key, "click", (low if x <= k else high) / 100, "{}") for x in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT key, floor10, level FROM ({catalogue.ORACLE_SQL['percentile_floor']}) ORDER BY key").fetchall()
    assert [tuple(r) for r in catalogue.QUERIES["percentile_floor"](spark, str(tmp_path)).orderBy("key").collect()] == want


def test_grid_between_rows(spark):
    p = spark.createDataFrame([(1, 1, -120, 5), (1, 2, 20, 6), (1, 3, 20, 7), (1, 4, None, 9), (1, 5, 170, None), (2, 1, 30, 1), (None, 1, 100, 3)], "key long, id long, t long, cents long")
    got = [(r["key"], r["g"], r["back"]["t"], r["back"]["v"], r["fore"] and r["fore"]["t"], r["fore"] and r["fore"]["v"]) for r in series.around_grid(p, "cents", 50).collect()]
    assert sorted(got, key=str) == sorted([(1, -100, -120, 5, 20, 6), (1, -50, -120, 5, 20, 6), (1, 0, -120, 5, 20, 6), (1, 50, 20, 7, 170, None), (1, 100, 20, 7, 170, None), (1, 150, 20, 7, 170, None), (None, 100, 100, 3, None, None)], key=str)
    plan = series.nearest_filled(p, "cents", 50)._jdf.queryExecution().optimizedPlan().toString()
    # one window over the rows alone: no grid time is sorted
    assert plan.count("Window [") == 1 and "Union" not in plan
