"""What is done inside a text's row gives what single words give, and moves no word."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import align, islands, retakes, text, timeline, tracks
from tidemark.plans import catalogue
from tidemark.sources import carriers, probes

DATA = "/root/testdata/sf0.001"


def lists(spark):
    rng = random.Random(5)
    texts = [[rng.choice(["", "a", "two.", "three,", "wait...", "déjà", "eleven letters!", "longestword"]) for _ in range(rng.randint(0, 60))] for _ in range(40)]
    return spark.createDataFrame([*enumerate(texts), (98, None), (99, ["", ""])], "key long, words array<string>")


def words(lists_):
    return lists_.select("key", F.posexplode("words").alias("i", "w")).where("w <> ''").withColumn("i", F.col("i").cast("long"))


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    got = sorted(map(str, a.select(columns).collect()))
    assert got == sorted(map(str, b.select(columns).collect())) and got


def shuffles(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Window [") + df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def test_parts(spark):
    t = lists(spark)
    same(islands.parts_of_lists(t, 12, 5), islands.regrouped(islands.parts(words(t), 12, 5)))


def test_remapped_spans(spark):
    t = lists(spark)
    line = islands.lineage(islands.parts(words(t), 12, 5))
    for a, b in ((3, 8), (0, 11), (5, 5), (9, 30)):
        choices = line.select("key", F.col("seg").alias("choice"), "seg", F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")).distinct()
        same(islands.spans_of_lists(t, 12, 5, a, b), islands.remapped_spans(choices, line))
    same(islands.spans_of_lists(spark.createDataFrame([(1, ["a", None, "b", "c", "d", "e", "f"])], "key long, words array<string>"), 12, 5, 1, 5), spark.createDataFrame([(1, 0, 0, 1, None), (1, 0, 1_000_005, 0, 0)], "key long, choice long, part long, first long, last long"))
    assert islands.spans_of_lists(t, 12, 5, 12, 20).count() == 0
    assert shuffles(catalogue.QUERIES["remapped_choices"](spark, DATA)) == 0


def test_short_islands(spark):
    t = lists(spark)
    marked = t.select("key", F.transform("words", lambda w: F.when(w != "", F.length(w) >= 4)).alias("marked"))
    same(tracks.short_islands_of_lists(marked, 3), tracks.short_islands(words(t).select("key", "i", (F.length("w") >= 4).alias("marked")), 3))


def test_captions(spark):
    t = lists(spark)
    broken = text.caption_breaks(words(t), 12)
    ws = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])
    per = broken.groupBy("key", "caption").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"), ws.alias("ws"))
    plain = per.select("key", "caption", "first", "last", "n", text.balanced_split(F.col("ws")).cast("long").alias("split"))
    got = text.caption_rows(t, 12)
    same(got.drop("following", "most"), plain)
    ends = per.select("key", "caption", F.col("first").alias("start"), F.max("last").over(catalogue.Window.partitionBy("key")).alias("total"))
    same(got.select("key", "caption", F.col("first").alias("start"), F.col("most").alias("total"), F.coalesce("following", "most").alias("end")), timeline.caption_ends(ends, "total"))


def plain_captions(words_, starts, ends_, moments, most_words, most_letters, pause):
    """The rule word by word."""
    groups, group = [], []
    at = lambda some, k: some[k] if some and k < len(some) else None
    for k, w in enumerate(words_ or []):
        if not w:
            continue
        if group and ((at(starts, k) or 0) - (at(ends_, group[-1]) or 0) > pause or at(moments, k) != at(moments, group[-1])):
            groups, group = [*groups, group], []
        group = [*group, k]
        last = w.rstrip()[-1:]
        if (last and last in ".!?") or len(group) >= most_words or sum(len(words_[x]) for x in group) > most_letters or (last == "," and len(group) >= 3):
            groups, group = [*groups, group], []
    return [(n, len(g), at(starts, g[0]) or 0, at(ends_, g[-1]) or 0, text.best_split([len(words_[x]) for x in g]), " ".join(words_[x] for x in g)) for n, g in enumerate([*groups, group] if group else groups)]


def test_captions_of_a_batch(spark):
    rng = random.Random(7)
    some = [None, "", "a", "b,", "déjà", "two.", "wide! ", "\u00a0", "eleven letters", "c"]
    rows = []
    for key in range(120):
        n = rng.randint(0, 50)
        times = sorted(rng.randint(0, 200 * n) for _ in range(2 * n))
        holes = lambda values: [None if rng.random() < 0.05 else x for x in values][: rng.choice([n, n, n, n // 2])]
        rows.append((key, rng.choices(some, [1, 1, 9, 2, 9, 1, 1, 1, 1, 9], k=n), holes(times[::2]), holes(times[1::2]), holes([k // 9 for k in range(n)])))
    rows += [(200, None, None, None, None), (201, ["a", "b"], None, None, None), (202, ["x"] * 3000, [], [], [])]
    spoken = spark.createDataFrame(rows, "key long, words array<string>, start array<bigint>, end array<bigint>, moment array<bigint>").coalesce(2)
    for limits in ((6, 26, 350), (1, 26, 350), (100, 5, 0), (40, 60, 10**9)):
        want = [(key, *c) for key, *lists_ in rows for c in plain_captions(*lists_, *limits)]
        assert sorted(map(tuple, timeline.captions(spoken, *limits).collect())) == sorted(want)
    filled = [(key, [w for w in words_ or [] if w]) for key, words_, *_ in rows]
    want = [(key, *c) for key, ws in filled for c in plain_captions(ws, [300 * k for k in range(len(ws))], [300 * k + 300 for k in range(len(ws))], [k // 12 for k in range(len(ws))], 6, 26, 350)]
    assert sorted(map(tuple, timeline.captions(spark.createDataFrame(filled, "key long, words array<string>"), clock=(300, 12)).collect())) == sorted(want)
    # only texts go to the workers: lists made for each word cost more than the words
    assert "transform(" not in catalogue.QUERIES["caption_groups"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_suggestions(spark):
    rng = random.Random(11)
    some = [None, "", "euh", "Hum...", "\u00a0", "moulin", "Moulins", "gate", "gate.", "l'eau", "attends", "recommence.", "je", "oups!", "the"]
    rows = [(1, None), (2, []), (3, ["", None]), (4, ["euh"] * 9), (5, ["je", "la", "Oups", "", "je"])]
    for key in range(10, 130):
        ws = rng.choices(some, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, len(ws))
            ws[a:a] = [*ws[a : a + rng.randint(2, 9)], *rng.choice(([], ["euh"], ["pardon"]))]
        rows.append((key, ws))
    t = spark.createDataFrame(rows, "key long, words array<string>").coalesce(2)
    timed = t.withColumn("ms", F.transform("words", lambda w, k: k * 7000))
    for size in (1, 3, 8):
        in_moments = words(t).withColumn("moment", F.floor(F.col("i") / size))
        for texts in (t, timed):
            got = retakes.suggestions_of_lists(texts, size)
            same(got, retakes.suggestions(in_moments, retakes.retake_flags(texts)))
            assert got.where("key < 4").count() == 0
        assert {r["reason"] for r in retakes.suggestions_of_lists(t, size).collect()} == {retakes.RETAKE, retakes.FALSE_START, retakes.HESITATION, retakes.ASIDE}
    assert retakes.suggestions_of_lists(t.limit(0), 8).count() == 0


def test_texts_together():
    rng = random.Random(12)
    texts = []
    for _ in range(150):
        ws = rng.choices(["euh", "moulin", "gate.", "river", "stone", "lamp", "the", "wait", None], k=rng.randint(0, 12))
        texts.append([*ws, *(w for w in ws if rng.random() < 0.8), *rng.choices(["oh", "fence", "the"], k=rng.randint(0, 2))])
    codes, sizes = retakes.coded([w for ws in texts for w in ws]), np.array([len(ws) for ws in texts])
    ends, ms = np.cumsum(sizes), np.concatenate([np.arange(n) * 300 for n in sizes])
    alone = [retakes.kinds_of(codes[end - n : end], ms[end - n : end]) for end, n in zip(ends, sizes, strict=True)]
    got = retakes.kinds_of(codes, ms, np.repeat(np.arange(len(sizes)), sizes))
    assert got.tolist() == np.concatenate(alone).tolist() and {0, 1, 2} == set(got.tolist())
    rows = list(retakes.together(np.array([0, 10, 5000, 5000, 9000, 9096, 9097, 9097])))
    assert rows == [(0, 2), (2, 3), (3, 6), (6, 8)] and list(retakes.together(np.zeros(0, np.int64))) == []


def test_highest_of_stretches():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 400)
    highest, first = retakes.Highest(values), rng.integers(0, 400, 3000)
    stop = np.minimum(first + rng.integers(0, retakes.BACK + 1, 3000), 400)
    value, place = highest.between(first, stop)
    assert value.tolist() == [max(values[a:b].tolist(), default=-1) for a, b in zip(first, stop, strict=True)]
    some = stop > first
    assert (values[place[some]] == value[some]).all() and (place[some] >= first[some]).all() and (place[some] < stop[some]).all()
    assert retakes.Highest(values[:0]).between(first[:0], stop[:0])[0].tolist() == []


def test_suggestions_of_documents(spark, tmp_path):
    take = "they painted seven garden gates this morning"
    documents = [(1, f"{take} {take} again"), (2, f"\n{take} {take} again"), (2, f" {take} oh {take}\n"), (4, None), (5, "\n")]
    spark.createDataFrame(documents, "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["moment_suggestions"](spark, str(tmp_path))
    # a line break before a text is a place without a word, which flags must count like the words do; rows of one key are texts of their own
    assert sorted(map(tuple, got.collect())) == [(2, 0, retakes.RETAKE), (2, 0, retakes.RETAKE)]
    # words in rows went through two shuffles, several times the size of the texts
    assert shuffles(got) == shuffles(catalogue.QUERIES["moment_suggestions"](spark, DATA)) == 0


def test_no_word_is_shuffled(spark):
    for name in ("split_segments", "short_islands", "balanced_split", "caption_ends"):
        assert shuffles(catalogue.QUERIES[name](spark, DATA)) == 0, name
    assert carriers.word_lists(spark, DATA).count() > 0


def test_band_keeps_its_pairs(spark):
    assert catalogue.QUERIES["band_self_join"](spark, DATA).columns == ["key", "i", "j"]


def test_merging_by_slices(spark):
    rng = random.Random(2)
    first = [[{"w": rng.choice("ab c'd"), "p": rng.random()} for _ in range(rng.randint(0, 9))] for _ in range(30)] + [None, [None, {"w": None, "p": None}]]
    second = [[rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(30)] + [["a"], [None]]
    a = pa.array(first, pa.list_(pa.struct([("w", pa.string()), ("p", pa.float64())])))
    b = pa.array(second, pa.list_(pa.string()))
    whole = align.merge_slices(a, b)
    assert len(whole) == 32 and all(align.merge_slices(a, b, n).equals(whole) for n in (1, 7, 40))


def test_settings_look_once(spark):
    probe = spark.createDataFrame([("x",), (None,)], "probe string").select(probes.settings(F.col("probe")).alias("s"))
    assert [r["s"] for r in probe.collect()] == [None, None]
    # a line that is looked for again for each field would stand in the plan some hundred times
    assert probe._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") < 30
