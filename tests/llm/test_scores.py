"""Classifiers, licence scans, sketches and language-model scores against plain versions and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tidemark.llm import common, license_scan, quality, scaled_sketch, suffix_tree_lm, toxicity

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1.0
    y = np.array(labels)
    n1, n0 = y.sum(), len(y) - y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize(("query", "label", "mod", "held", "least"), [(quality.op1_pu_quality, "quality", 5, 0, 0.95), (toxicity.op8_toxicity, "toxic", 4, 2, 0.93)])
def test_held_out_accuracy(spark, query, label, mod, held, least):
    got = query(spark, LARGER).join(common.table(spark, LARGER, "labels"), "doc_id").toPandas()
    assert all(h == (crc32(str(d).encode()) % mod == held) for d, h in zip(got["doc_id"], got["held_out"]))
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    out = got[got["held_out"]]
    assert auc(out["score"].to_numpy(), out[label].to_numpy()) >= least


def test_held_out_labels_are_not_read(spark):
    docs = common.table(spark, LARGER, "documents").limit(2000)
    labels = common.table(spark, LARGER, "labels")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.weights == b.weights and a.curve == b.curve


def test_folding():
    assert toxicity.folded("M0r0n!! іdiоt (1d1ot) s­cum") == " moron idiot idiot scum "
    assert toxicity.folded("") == "  "
    assert toxicity.folded("ídiot ìdio\u0301t scüm") == " idiot idiot scum "
    model = toxicity.Model({" trash ": 3.0, " idio": 2.0}, (" trash can ",), (1.0, 0.0, -1.0))
    a = toxicity.automaton(model)
    assert toxicity.hits(a, "the trash can is full of trash, id10tic") == (5.0, 8)
    assert toxicity.hits(a, "") == (0.0, 0)


def test_exceptions_and_hits_in_linear_time():
    """A text of many hits and exceptions: as by trying all of them, and a long one at once."""
    import random
    import time

    model = toxicity.Model({" trash": 2.0, " idiot ": 3.0, "rash c": 1.0}, (" trash can ", " an idiot savant ", " can idiot "), (1.0, 0.5, -3.5))
    a = toxicity.automaton(model)
    rng = random.Random(1)
    for _ in range(300):
        text = " ".join(rng.choice(["trash", "can", "idiot", "an", "savant", "x"]) for _ in range(rng.randrange(12)))
        best, spared = {}, []
        folded = toxicity.folded(text)
        for end, (size, weight) in a.iter(folded):
            start = end - size + 1
            if weight is None:
                spared.append((start, end))
            else:
                best[start] = max(weight, best.get(start, 0.0))
        want = sum(w for s, w in best.items() if not any(x <= s < y for x, y in spared))
        assert toxicity.hits(a, text)[0] == want
    began = time.perf_counter()
    toxicity.hits(a, "trash can idiot " * 100_000)
    assert time.perf_counter() - began < 20


def test_classifiers_take_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(awkward, labels)
    assert toxicity.score(awkward, model).count() == awkward.count()
    kept = toxicity.accepted(awkward, model)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert quality.fit(awkward, labels) is None
    assert quality.score(awkward, None).count() == awkward.count()
    assert toxicity.score(empty, model).count() == 0 and quality.score(empty, None).count() == 0
    assert toxicity.fit(empty, labels.limit(0)).weights


def test_rare_entries_are_found_among_many_common_ones(spark):
    filler = " ".join("".join(chr(97 + k // 26**j % 26) for j in (0, 1, 2)) * 4 for k in range(12_000))
    ids = [d for d in range(100) if crc32(str(d).encode()) % 4 != 2][:40]
    docs = spark.createDataFrame([(d, filler + (" grobnik" if k < 6 else "")) for k, d in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(k < 20)) for k, d in enumerate(ids)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert toxicity.hits(toxicity.automaton(model), "a grobnik")[0] > 0


def test_substitutions_at_both_ends_are_folded():
    assert toxicity.folded("idi0t5 $cum @sshole mor0n5! !diot 1345 $5") == " idiots scum asshole morons idiot "


def test_negative_risk_stays_above_zero():
    rng = np.random.default_rng(0)
    p, n = rng.normal(1, 1, (400, 3)), rng.normal(-1, 1, (400, 3))
    u = np.vstack([p[:200] + 0.01, n[:200]])
    of = lambda x: quality.Moments.of(x).standardised(np.zeros(3), np.ones(3))
    w, c = quality.non_negative_pu(of(p[200:]), of(u), 0.5, rate=1e-2)
    assert ((n[200:] @ w + c) < 0).mean() > 0.9 and ((p[:200] @ w + c) > 0).mean() > 0.9


def test_moments_are_those_of_all_documents(spark, awkward, empty):
    texts = [r[1] for r in awkward.collect()]
    x = np.stack([quality.statistics((t or "").encode()) for t in texts]).astype(float)
    got = quality.moments(awkward.toDF(*[f"x{i}" for i in range(len(awkward.columns))]).selectExpr("x1 as text").repartition(5))
    assert got.n == len(texts) and np.allclose(got.mean, x.mean(0)) and np.allclose(got.product, x.T @ x / len(x))
    middle, spread = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([(x - middle) / spread, np.ones((len(x), 1))])
    own = got.standardised(middle, spread)
    assert np.allclose(own.mean, z.mean(0)) and np.allclose(own.product, z.T @ z / len(z))
    assert quality.moments(empty) is None


def test_the_risk_is_the_one_over_documents(spark):
    """Descent by moments goes where descent over the documents themselves goes."""
    rng = np.random.default_rng(3)
    p, u = rng.normal(0.5, 1, (60, 4)), np.vstack([rng.normal(0.5, 1, (150, 4)), rng.normal(-0.7, 1, (90, 4))])
    of = lambda x: quality.Moments.of(x).standardised(np.zeros(4), np.ones(4))
    w, c = quality.non_negative_pu(of(p), of(u), 0.6, steps=4000, rate=1e-3, ridge=0.05)

    def risk(w, c):
        loss = lambda g, y: ((1 - y * g) ** 2 / 4).mean()
        return 0.6 * loss(p @ w + c, 1) + max(0.0, loss(u @ w + c, -1) - 0.6 * loss(p @ w + c, -1)) + 0.05 * (w @ w) / 2

    best = risk(w, c)
    assert all(risk(w + rng.normal(0, 0.05, 4), c + rng.normal(0, 0.05)) > best - 1e-3 for _ in range(200))


def test_quality_is_fitted_on_awkward_rows(spark, awkward):
    plain = awkward.toDF(*[f"x{i}" for i in range(len(awkward.columns))]).selectExpr("x0 as doc_id", "x1 as text")
    ids = [d for d in range(100, 200) if crc32(str(d).encode()) % 5 != 0]
    more = spark.createDataFrame([(d, "good words in a line" if d % 2 else "### !!! 000") for d in ids] + [(ids[1], "good words in a line")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in ids] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(plain.unionAll(more), labels)
    got = quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and all(0 <= r["score"] <= 1 for r in got)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(label, k) for phrase, label in license_scan.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for _, k in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for label, _ in places}))


def test_base_phrases(spark):
    texts = {r["doc_id"]: r["text"] for r in common.table(spark, SMALL, "documents").collect()}
    for r in license_scan.op3_license_scan(spark, SMALL).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_scan(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_random_words_of_the_phrases():
    rng = random.Random(2)
    own = license_scan.scanner()
    vocabulary = "mit license apache general public x the version 2 0 gnu licensed under".split()
    for _ in range(400):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))
        got = own.scan(text.encode())
        assert (got["n_words"], got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == plain_scan(text)


def test_matching_statistics():
    rng = random.Random(3)
    texts = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 12))] for _ in range(6)]
    a = license_scan.Automaton(texts)
    parts = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for _ in range(50):
        word = [rng.choice("abcd").encode() for _ in range(30)]
        state = size = 0
        for k, w in enumerate(word):
            state, size = a.walk(state, size, a.vocabulary.get(w, 0))
            longest = max((n for n in range(1, k + 2) if tuple(word[k + 1 - n : k + 1]) in parts), default=0)
            assert size == longest


def test_templates_with_gaps_are_found():
    own = license_scan.scanner()
    text = license_scan.TEMPLATES[0][1].replace("free of charge", "free of any charge")
    assert "mit" in own.scan(text.encode())["labels"].split(",")
    assert own.scan(b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by-nc"
    assert own.scan(b"")["score"] == 0.0


def test_license_scan_takes_awkward_rows(spark, awkward, empty):
    assert license_scan.scan(awkward).count() == awkward.count() and license_scan.scan(empty).count() == 0


def test_sketch_contract(spark):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in common.table(spark, SMALL, "documents").collect()), reverse=True)
    got = {r["doc_id"]: r for r in scaled_sketch.op7_scaled_sketch(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for k, (d, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 2
        new = text[: len(text) - n] + following[:n]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = (scaled_sketch.sketch(x) for x in (text, new, following))
        assert r["fingerprint"] == scaled_sketch.encoded(a) and np.array_equal(scaled_sketch.decoded(r["edited_fingerprint"]), b)
        assert r["near_edited"] == scaled_sketch.likeness(a, b) and r["near_next"] == scaled_sketch.likeness(a, c)


def test_sketches_merge_and_estimate_containment():
    rng = random.Random(4)
    whole = " ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000))
    part = whole[: len(whole) // 50]
    other = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400))
    a, b, c = map(scaled_sketch.sketch, (whole, part, other))
    assert scaled_sketch.likeness(a, b) > 0.97 and scaled_sketch.likeness(a, c) < 0.03
    assert 0.4 < scaled_sketch.likeness(scaled_sketch.merged(a, b), scaled_sketch.merged(b, c)) <= 1
    exact = {scaled_sketch.sketch(x)[0] for x in (whole[k : k + 16] for k in range(200))}
    assert len(exact) > 150
    assert np.array_equal(scaled_sketch.merged(a, b), a)


def test_sketch_takes_awkward_rows(spark, awkward, empty):
    for buckets in (1, 3, 40):
        got = scaled_sketch.fingerprints(awkward, buckets).collect()
        assert len(got) == awkward.count()
    one = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert scaled_sketch.fingerprints(one).first()["near_next"] == 1.0
    assert scaled_sketch.fingerprints(empty).count() == 0


def test_base_scores(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree_lm, "HEAD", 50)  # most words go the way of rare ones
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in common.table(spark, SMALL, "documents").collect()}
    counts = Counter(w for d, t in texts.items() if crc32(str(d).encode()) % 5 != 1 for w in t)
    total, distinct = sum(counts.values()), len(counts)
    for r in suffix_tree_lm.op9_suffix_tree_score(spark, SMALL).collect():
        t = texts[r["doc_id"]]
        want = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(counts[w] > 0 for w in t), total)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want) and r["score"] < 0
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_automaton_scores_like_a_walk(spark):
    """Lane by lane equals symbol by symbol with the longest kept context looked up anew, and probabilities sum to one."""
    docs = common.table(spark, SMALL, "documents").limit(60)
    training = docs.selectExpr("cast(text as binary) as text")
    tree = suffix_tree_lm.grown(training.mapInArrow(suffix_tree_lm.count_grams, "gram long, n long").groupBy("gram").sum("n").toDF("gram", "n"))
    used = tree.logs.shape[1] - 1
    p = 10.0 ** tree.logs.astype(float)
    assert np.allclose(p[:, :used].sum(1) + p[:, used] * (256 - used), 1, atol=1e-4)
    stream = np.frombuffer(b"".join(suffix_tree_lm.stream_of(suffix_tree_lm.words_of(r["text"])) for r in training.limit(8).collect()), np.uint8)
    state, want = 0, []
    for _ in range(suffix_tree_lm.DEPTH):
        state = int(tree.following[state, tree.column_of[suffix_tree_lm.END]])
    for b in stream.tolist():
        want.append(tree.logs[state, tree.column_of[b]])
        state = int(tree.following[state, tree.column_of[b]])
    assert np.allclose(tree.symbol_logs(stream), want)


def test_states_outside_the_automaton_count_as_those_inside(spark, monkeypatch):
    docs = common.table(spark, SMALL, "documents").limit(60)
    want = {r["doc_id"]: r for r in suffix_tree_lm.score(docs).collect()}
    monkeypatch.setattr(suffix_tree_lm, "MOST_STATES", 40)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(docs).collect()}
    assert got.keys() == want.keys() and all(abs(got[d]["score"] - want[d]["score"]) < 1e-5 * abs(want[d]["score"]) for d in want)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    got = suffix_tree_lm.op9_suffix_tree_score(spark, LARGER).where("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum()


def test_scores_take_awkward_rows(spark, awkward, empty):
    got = suffix_tree_lm.score(awkward).collect()
    assert len(got) == awkward.count() and all(r["score"] < 0 for r in got)
    assert suffix_tree_lm.score(empty).count() == 0
    held = spark.createDataFrame([(next(d for d in range(99) if crc32(str(d).encode()) % 5 == 1), "some words")], "doc_id long, text string")
    r = suffix_tree_lm.score(held).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 3) and abs(r["base_score"]) < 1e-9


def plain_suffix_tree(training: list[bytes]):
    """log10 probability of a text by contexts counted, tested and looked up one by one."""
    depth = suffix_tree_lm.DEPTH
    counts: dict[bytes, Counter] = {}
    for text in training:
        stream = suffix_tree_lm.stream_of(suffix_tree_lm.words_of(text))
        for i in range(depth, len(stream)):
            for k in range(depth + 1):
                counts.setdefault(stream[i - k : i], Counter())[stream[i]] += 1
    states = {b""}
    for context, own in counts.items():
        if context:
            short, total = counts[context[1:]], own.total()
            gain = sum(n * (math.log(n) - math.log(short[x])) for x, n in own.items()) + total * (math.log(short.total()) - math.log(total))
            if gain > suffix_tree_lm.LEAST_GAIN * len(own):
                states |= {context[a:b] for a in range(len(context)) for b in range(a + 1, len(context) + 1)}

    def p(context, x):
        own = counts[context]
        if not context:
            return (own[x] + len(own) / 256) / (own.total() + len(own))
        return (own[x] + len(own) * p(context[1:], x)) / (own.total() + len(own))

    def score(text):
        stream, out = suffix_tree_lm.stream_of(suffix_tree_lm.words_of(text)), 0.0
        for i in range(depth, len(stream)):
            context = next(stream[i - k : i] for k in range(depth, -1, -1) if stream[i - k : i] in states)
            out += math.log10(p(context, stream[i]))
        return out

    return score, len(states)


@pytest.mark.parametrize("most_states", [1 << 16, 30])
def test_suffix_tree_plain_version(spark, monkeypatch, most_states):
    monkeypatch.setattr(suffix_tree_lm, "MOST_STATES", most_states)
    rng = random.Random(12)
    words = "ein eins zwei drei bach bäche Haus hausen am um".split()
    texts = {d: " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))).encode() for d in range(80)}
    held = {d for d in texts if crc32(str(d).encode()) % 5 == 1}
    plain, states = plain_suffix_tree([t for d, t in texts.items() if d not in held])
    assert states > 60
    got = suffix_tree_lm.score(spark.createDataFrame([(d, t.decode()) for d, t in texts.items()], "doc_id long, text string")).collect()
    for r in got:
        want = plain(texts[r["doc_id"]])
        assert abs(r["score"] - want) < 1e-4 * max(1.0, abs(want))


def test_lexicon_plain_version(spark):
    """Weights, exceptions left aside, by counting documents one by one."""
    rng = random.Random(13)
    bad, filler = ["grobnik", "grobniks", "zarvel", "plundered"], [f"wort{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    ids = [d for d in range(400) if crc32(str(d).encode()) % 4 != 2]
    rows = [(d, " ".join([rng.choice(filler) for _ in range(30)] + [rng.choice(bad) for _ in range(3 if k % 2 else 0)] + ([rng.choice(bad)] if rng.random() < 0.05 else [])), k % 2) for k, d in enumerate(ids)]
    model = toxicity.fit(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int"))
    held, size = {}, Counter(y for _, _, y in rows)
    for _, text, y in rows:
        for e in toxicity.entries_of(text):
            held.setdefault(e, [0, 0])[y] += 1
    lift = {e: math.log((n[1] + 0.5) / (size[1] + 1)) - math.log((n[0] + 0.5) / (size[0] + 1)) for e, n in held.items()}
    for entry, weight in model.weights.items():
        if entry.strip() not in toxicity.SEED:
            assert abs(weight - lift[entry]) < 1e-9 and held[entry][1] >= toxicity.LEAST_DOCS and lift[entry] >= math.log(toxicity.LEAST_LIFT)
    a = toxicity.automaton(model)
    # every entry that passes the test is matched, if not by itself then by a shorter one of nearly its weight
    for e, w in lift.items():
        if held[e][1] >= toxicity.LEAST_DOCS and w >= math.log(toxicity.LEAST_LIFT) and e.endswith(" "):
            assert toxicity.hits(a, e)[0] >= w - 1.0
    clean = [w for w in filler if lift[f" {w} "] < math.log(toxicity.LEAST_LIFT)]
    assert len(clean) > 150 and all(toxicity.hits(a, w)[0] == 0 for w in clean if not any(f" {w}".startswith(e) for e in model.weights))
