"""The pipeline's stages one by one against plain versions, and its result."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"

import corpus_pipeline
from tidemark.llm import common, decontamination, packing, simhash_dedup, toxicity
from test_duplicates import plain_removed


def test_stages(spark):
    docs = common.table(spark, DATA, "documents")
    columns = docs.columns
    model = toxicity.fit(docs, common.table(spark, DATA, "labels"))
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= toxicity.THRESHOLD}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]

    kept = common.stored(stages["toxicity"](spark, docs, DATA), "test")
    assert kept.columns == columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == texts

    lines = common.stored(stages["line dedup"](spark, kept, DATA), "test")
    assert lines.columns == columns
    gone = plain_removed(list(texts.items()))
    texts = {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in texts.items()}
    assert {r["doc_id"]: r["text"] for r in lines.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in lines.collect())

    single = common.stored(stages["SimHash near-dedup"](spark, lines, DATA), "test")
    assert single.columns == columns
    groups = simhash_dedup.groups(lines, simhash_dedup.SIMILAR).collect()
    first = {}
    for r in groups:
        first[r["root"]] = min(r["doc_id"], first.get(r["root"], r["doc_id"]))
    assert {r["doc_id"] for r in single.collect()} == set(first.values())
    texts = {d: texts[d] for d in first.values()}

    clean = common.stored(stages["benchmark decontamination"](spark, single, DATA), "test")
    assert clean.columns == columns
    items = [" " + " ".join(decontamination.words_of(r["text"])) + " " for r in common.table(spark, DATA, "benchmark").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for d, t in texts.items():
        plain = f" {' '.join(decontamination.words_of(t))} "
        if any(i in plain for i in items):
            assert d not in left
    leaks = {r["doc_id"] for r in decontamination.leaks(single, common.table(spark, DATA, "benchmark")).collect()}
    assert left == set(texts) - leaks

    packed = stages["packing"](spark, clean, DATA).collect()
    assert {r["doc_id"] for r in packed} == left
    assert sorted(map(str, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(str, packed))


def test_empty_documents(spark, empty):
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, DATA), "test")
        assert docs.count() == 0, name
    assert packing.pack(empty).columns == docs.columns


def test_awkward_documents(spark, awkward):
    docs, left = awkward, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA)
        assert docs.columns == awkward.columns, name
        # names may clash, so what is between the stages is written under other names
        docs = common.stored(docs.toDF(*[f"x{i}" for i in range(len(docs.columns))]), "test").toDF(*awkward.columns)
        left.append(docs.count())
    assert left[0] == left[1] == awkward.count()
    # all texts without words are one group; the line that stands alone in repeated documents went before
    texts = [r[1] for r in docs.collect()]
    assert sum(not (t or "").strip() for t in texts) == 1 and left[2] == left[3] == len(texts)
    assert packing.pack(docs).count() > 0
