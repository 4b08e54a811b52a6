"""Streams of jobs: batches and restarts give what one batch gives; status by timers; awkward lines."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.plans import stateful
from tidemark.streaming import jobs

DATA = "/root/testdata/sf0.001"
LINES = "key long, id long, t long, line string"


def collected(df):
    return sorted((str(tuple(r)) for r in df.select("key", "what", "label", "began", "ended", "start").collect()))


def written(df, path, age):
    df.coalesce(1).write.mode("append").parquet(path)
    for part in os.listdir(path):
        if part.startswith("part-"):
            os.utime(f"{path}/{part}", (1_700_000_000 + age,) * 2)


def test_restarts_change_nothing(spark, tmp_path):
    lines = stateful.as_lines(spark.read.parquet(f"{DATA}/events.parquet"))
    want = collected(jobs.replayed(stateful.lines_stream(spark, DATA)))
    bounds = lines.approxQuantile("t", [0.3, 0.6], 0.0)
    source = str(tmp_path / "in")
    for k, part in enumerate((F.col("t") < bounds[0], F.col("t").between(bounds[0], bounds[1] - 1), F.col("t") >= bounds[1])):
        written(lines.where(part), source, k)
        stream = spark.readStream.schema(LINES).parquet(source)
        got = jobs.run_once(jobs.periods(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert collected(got) == want


def streamed(spark, tmp_path, rows, name="one", **options):
    written(spark.createDataFrame(rows, LINES), str(tmp_path / name), 0)
    stream = jobs.periods(spark.readStream.schema(LINES).parquet(str(tmp_path / name)), **options)
    return jobs.run_once(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-checkpoint"))


def test_phases_sides_and_busy_time(spark, tmp_path):
    s = 1_000_000
    rows = [
        (1, 1, 0, "@progression 10 100 copy"),
        (1, 2, 5 * s, "@parallele 77 audio"),
        (1, 3, 6 * s, "@progression 3 10 audio"),
        (1, 4, 8 * s, "@progression 50 100 copy"),
        (1, 5, 10 * s, "@progression 0 4 words"),  # closes copy
        (1, 6, 12 * s, "@fin-operation"),
        (1, 7, 15 * s, "@parallele-fin audio"),
        (1, 8, 15 * s, "@parallele-fin audio"),  # ended already
        (1, 9, 20 * s, "@memoire words"),
        (1, 10, 30 * s, "some other line"),
        (1, 11, 31 * s, "@progression x y words"),
        (2, 12, 5, "@fin-operation"),
        (2, 13, 6, "@parallele-fin nothing"),
        (2, 14, None, "@progression 1 2 a"),
        (None, 15, 7, "@progression 1 0 a"),
        (None, 16, 9, "@progression 1e+00 2 b"),
        (3, 17, 1, None),
    ]
    got = streamed(spark, tmp_path, rows)
    assert collected(got) == sorted(
        str(x)
        for x in [
            (1, "phase", "copy", 0, 10 * s, 0.1),
            (1, "phase", "words", 10 * s, 12 * s, 0.0),
            (1, "side", "audio", 5 * s, 15 * s, 0.3),
            (1, "busy", None, 0, 15 * s, None),
            (None, "phase", "a", 7, 9, 0.0),
        ]
    )


def test_quiet_jobs_tell_their_state(spark, tmp_path):
    s = 1_000_000
    rows = [(1, 1, 100 * s, "@progression 0 100 copy"), (1, 2, 110 * s, "@progression 0 50 words"), (1, 3, 120 * s, "@progression 10 50 words"), (2, 4, 4000 * s, "@progression 1 2 copy")]
    got = streamed(spark, tmp_path, rows, plan=("copy", "words"), planned={"copy": 20.0, "words": 40.0}, quiet_ms=30_000)
    told = got.where("what = 'status'").collect()
    assert len(told) == 1
    r = told[0]
    assert (r["key"], r["current"], r["done"], r["total"], r["plan_at"], r["busy"], r["sides"]) == (1, "words", 10.0, 50.0, 1, 20 * s, 0)
    # copy took half of what was planned, so words are planned at 20 s; a fifth is done in 10 s, which counts for four fifths
    assert abs(r["left"] - (0.8 * 40 + 0.2 * 16)) < 1e-9


def test_nothing(spark, tmp_path):
    assert streamed(spark, tmp_path, []).count() == 0


def test_lines_of_a_batch_are_read_in_order(spark, tmp_path):
    rows = [(1, 5, 30, "@fin-operation"), (1, None, 10, "@progression 1e400 2 a\x1fb "), (1, 3, 10, "@progression 1 4 c"), (1, 4, 10, "@memoire  "), (1, 2, 20, "@progression 3 4 c")]
    assert collected(streamed(spark, tmp_path, rows)) == sorted(str(x) for x in [(1, "phase", "a\x1fb", 10, 10, 1.0), (1, "phase", "c", 10, 30, 0.25), (1, "busy", None, 10, 30, None)])


class Store:
    """A state store that counts what it is asked."""

    def __init__(self):
        self.asked, self.kept = 0, {}

    def getValueState(self, name, schema):
        return Variable(self, name, None)

    def getListState(self, name, schema):
        return Variable(self, name, [])


class Variable:
    def __init__(self, store, name, usual):
        self.store, self.name, self.usual = store, name, usual

    def get(self):
        self.store.asked += 1
        return self.store.kept.get(self.name, self.usual)

    def update(self, x):
        self.store.asked += 1
        self.store.kept[self.name] = x

    put = update


def test_a_job_asks_its_store_a_few_times_only():
    store, told = Store(), jobs.JobProcessor((), {}, None)
    told.init(store)
    line = lambda t, what, label: {"told": "\x1f".join([str(t), str(t), what, "1.0", "4.0", label])}
    first = [line(2 * k + j, what, f"l{k % 20}") for k in range(40) for j, what in enumerate(("side", "progress"))]
    assert list(told.handleInputRows((7,), iter(first), None)) == [] and store.asked == 3
    closed = list(told.handleInputRows((7,), iter([line(100 + k, "side end", f"l{k}") for k in range(20)]), None))
    # each label asked for by itself would be twenty times and more
    assert store.asked == 7
    assert [(r["what"], r["label"], r["began"], r["ended"], r["start"]) for r in closed] == [("side", f"l{k}", 40 + 2 * k, 100 + k, 0.25) for k in range(20)] + [("busy", None, 0, 119, None)]
