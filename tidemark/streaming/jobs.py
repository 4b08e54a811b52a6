"""Jobs told by their lines: operations, side operations that run along with them, busy time and remaining time.

A job's state is kept in the state store: a value (the running operation, busy time, plan position, last line), a list with
a row for each label (its side operation, and what it has taken), and a timer that tells the state of a job that has gone
quiet. What is asked of the store costs far more than a line, so a job asks for its value once, for its list only if it was
told before, and puts both back once. Closed periods are rows of the result, so the state grows with labels, not with lines.

Defined cases. Lines that say nothing of these are left out; a null key is a job of its own. Lines of a batch are read by
time and id; one that comes late counts at the time of the last one read. An end without a beginning is ignored; a second
start of a running side operation takes the place of the first."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.sources import work

# How a job tells what it does. Numbers may have an exponent.
PROGRESS = r"^@progression ([\d.e+-]+) ([\d.e+-]+) (.+)$"
SIDE_START = r"^@parallele (\d+) (.+)$"
SIDE_END = r"^@parallele-fin (.+)$"
MEMORY = r"^@memoire (.+)$"
END = "@fin-operation"
SEPARATOR = "\x1f"

#: A speed that is measured counts in full from this share of an operation on, and at all after so many seconds.
FULL_SHARE, LEAST_SECONDS = 0.25, 3.0
#: Bounds of the ratio between the time that operations took and the time that was planned for them.
SLOWEST, FASTEST = 10.0, 0.1

PERIODS = "key long, what string, label string, began long, ended long, start double"
STATUS = "current string, done double, total double, plan_at int, busy long, sides int, left double"
TOLD = Row(*[c.split()[0] for c in f"{PERIODS}, {STATUS}".split(", ")])

#: The state's variables: the running operation and the clock, with the number of labels; each label's time and side operation.
JOB = "label string, done double, total double, since long, last long, start double, ended boolean, busy_from long, busy long, memory string, plan_at int, at long, labels int"
LABELS = "label string, micros long, first double, since long, done double, total double, start double, ended boolean"
NOW, SIDE = ("label", "done", "total", "since", "at", "start", "ended"), ("since", "done", "total", "start", "ended")


def dispatched(lines: DataFrame) -> DataFrame:
    """(key, id, t, what, label, done, total) of lines (key, id, t, line); t in microseconds."""
    number = lambda k: F.regexp_extract("line", PROGRESS, k).try_cast("double")
    what = (
        F.when(F.col("line").rlike(PROGRESS), "progress")
        .when(F.col("line").rlike(SIDE_START), "side")
        .when(F.col("line").rlike(SIDE_END), "side end")
        .when(F.col("line") == END, "end")
        .when(F.col("line").rlike(MEMORY), "memory")
    )
    label = F.coalesce(*[F.nullif(F.trim(F.regexp_extract("line", p, k)), F.lit("")) for p, k in ((PROGRESS, 3), (SIDE_START, 2), (SIDE_END, 1), (MEMORY, 1))])
    found = lines.select("key", "id", "t", what.alias("what"), label.alias("label"), number(1).alias("done"), number(2).alias("total"))
    return found.where("what is not null and t is not null and (what <> 'progress' or (done is not null and total is not null))")


def packed(told: DataFrame) -> Column:
    """What dispatched() tells of a line as one text: a worker takes each value of a row by itself, which costs more than to
    split a text. The label, which may hold anything but is never empty, comes last."""
    some = lambda c: F.coalesce(told[c].cast("string"), F.lit(""))
    return F.concat_ws(SEPARATOR, *map(some, ("t", "id", "what", "done", "total", "label")))


def unpacked(told: str) -> tuple:
    """(t, (whether there is an id, id), what, label, done, total), which sort by time and id, null ids first."""
    t, i, what, done, total, label = told.split(SEPARATOR, 5)
    return int(t), (bool(i), int(i or 0)), what, label or None, float(done) if done else None, float(total) if total else None


def share(done: float, total: float) -> float:
    return min(1.0, done / total) if total else 0.0


class Job:
    """The state of one job, and what a line does to it."""

    def __init__(self) -> None:
        self.now: dict[str, Any] | None = None  # label, done, total, since, at, start, ended
        self.busy_from: int | None = None
        self.busy = 0
        self.memory: str | None = None
        self.plan_at = -1
        self.at: int | None = None
        self.sides: dict[str, dict[str, Any]] = {}  # since, done, total, start, ended
        self.spent: dict[str, tuple[int, float]] = {}  # microseconds, share done at the first start
        self.changed = False  # whether `sides` or `spent` did

    def read(self, t: int, what: str, label: str | None, done: float, total: float, plan: tuple[str, ...]) -> list[tuple]:
        """Closed periods: (what, label, began, ended, start)."""
        t = t if self.at is None else max(t, self.at)
        self.at = t
        closed: list[tuple] = []
        side = self.sides.get(label) if label is not None else None
        if what == "memory":
            self.memory = label
        elif what == "side":
            self.sides[label] = {"since": t, "done": 0.0, "total": 0.0, "start": None, "ended": False}
            self.changed = True
        elif what == "side end":
            if side and not side["ended"]:
                side["ended"] = True
                self.changed = True
                closed.append(self.charged("side", label, side["since"], t, side["start"] or 0.0))
        elif what == "end":
            closed += self.ended(t)
        elif side and not side["ended"]:
            side.update(done=done, total=total, start=share(done, total) if side["start"] is None and total else side["start"])
            self.changed = True
        else:
            same = self.now is not None and self.now["label"] == label
            if not same:
                closed += self.ended(t)
            first = {"since": t, "start": share(done, total)} if not same else {k: self.now[k] for k in ("since", "start")}
            self.now = {"label": label, "done": done, "total": total, "at": t, "ended": False, **first}
            self.memory = None
            if label in plan:
                self.plan_at = max(self.plan_at, plan.index(label))
        running = (self.now is not None and not self.now["ended"]) or any(not s["ended"] for s in self.sides.values())
        if running and self.busy_from is None:
            self.busy_from = t
        elif not running and self.busy_from is not None:
            closed.append(("busy", None, self.busy_from, t, None))
            self.busy, self.busy_from = self.busy + t - self.busy_from, None
        return closed

    def ended(self, t: int) -> list[tuple]:
        if self.now is None or self.now["ended"]:
            return []
        self.now["ended"] = True
        return [self.charged("phase", self.now["label"], self.now["since"], t, self.now["start"])]

    def charged(self, what: str, label: str, since: int, t: int, start: float) -> tuple:
        before, first = self.spent.get(label, (0, start))
        self.spent[label], self.changed = (before + t - since, first), True
        return (what, label, since, t, start)

    def speed(self, planned: dict[str, float]) -> float:
        """How much longer the operations that ended took than was planned."""
        known = [(micros / 1e6, planned[label] * (1 - start)) for label, (micros, start) in self.spent.items() if label in planned]
        real, due = sum(a for a, _ in known), sum(b for _, b in known)
        return 1.0 if real < 1 or due < 1 else min(SLOWEST, max(FASTEST, real / due))

    def left(self, planned: dict[str, float], t: int) -> float | None:
        """Seconds left of the running operation: as planned, and more and more as measured."""
        if self.now is None or self.now["ended"]:
            return None
        f, f0 = share(self.now["done"], self.now["total"]), self.now["start"]
        model = planned.get(self.now["label"], 0.0) * self.speed(planned) * (1 - f)
        elapsed = (t - self.now["since"]) / 1e6
        live = elapsed * (1 - f) / (f - f0) if f > f0 and elapsed > LEAST_SECONDS else model
        weight = min(1.0, (f - f0) / FULL_SHARE)
        return weight * live + (1 - weight) * model

    def status(self, planned: dict[str, float]) -> tuple:
        now, t = self.now or {"label": None, "done": None, "total": None}, self.at or 0
        busy = self.busy + (t - self.busy_from if self.busy_from is not None else 0)
        sides = sum(not s["ended"] for s in self.sides.values())
        return (now["label"], now["done"], now["total"], self.plan_at, busy, sides, self.left(planned, t))


class JobProcessor(StatefulProcessor):
    """Rows of PERIODS and STATUS: closed periods as they close, and the state of a job (what = 'status') once it has been
    quiet for `quiet_ms`, if that is given."""

    def __init__(self, plan: tuple[str, ...], planned: dict[str, float], quiet_ms: int | None) -> None:
        self.plan, self.planned, self.quiet_ms = plan, planned, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB)
        self.labels = handle.getListState("labels", LABELS)

    def loaded(self) -> Job:
        job, known = Job(), self.job.get()
        if known is not None:
            now, (job.busy_from, job.busy, job.memory, job.plan_at, job.at, labels) = known[: len(NOW)], known[len(NOW) :]
            job.now = dict(zip(NOW, now, strict=True)) if now[NOW.index("since")] is not None else None
            for label, micros, first, *side in self.labels.get() if labels else ():
                if side[0] is not None:
                    job.sides[label] = dict(zip(SIDE, side, strict=True))
                if micros is not None:
                    job.spent[label] = (micros, first)
        return job

    def saved(self, job: Job) -> None:
        labels = list(dict.fromkeys([*job.sides, *job.spent]))
        now = (None,) * len(NOW) if job.now is None else tuple(job.now[k] for k in NOW)
        self.job.update((*now, job.busy_from, job.busy, job.memory, job.plan_at, job.at, len(labels)))
        if job.changed:
            side = lambda label: tuple(job.sides[label][k] for k in SIDE) if label in job.sides else (None,) * len(SIDE)
            self.labels.put([(label, *job.spent.get(label, (None, None)), *side(label)) for label in labels])

    def rows(self, key: Any, closed: list[tuple], status: tuple | None = None) -> Iterator[Row]:
        for c in closed:
            yield TOLD(key, *c, *(None,) * 7)
        if status:
            yield TOLD(key, "status", *(None,) * 4, *status)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        job, closed = self.loaded(), []
        for t, _, what, label, done, total in sorted((unpacked(row["told"]) for row in rows), key=lambda x: x[:2]):
            closed += job.read(t, what, label, done, total, self.plan)
        self.saved(job)
        if self.quiet_ms is not None:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.handle.registerTimer(job.at // 1000 + self.quiet_ms)
        return self.rows(key[0], closed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        return self.rows(key[0], [], self.loaded().status(self.planned))

    def close(self) -> None:
        pass


def periods(lines: DataFrame, plan: tuple[str, ...] = (), planned: dict[str, float] | None = None, quiet_ms: int | None = None, late: str = "1 minute") -> DataFrame:
    """A stream of the lines' closed periods, and of the states of quiet jobs. `planned` gives seconds for each label. With
    `quiet_ms` lines are held against a watermark of `late`, without it none is late."""
    found = dispatched(lines)
    told = found.select("key", packed(found).alias("told"), *([F.timestamp_micros("t").alias("ts")] if quiet_ms is not None else []))
    if quiet_ms is not None:
        told = told.withWatermark("ts", late)
    schema = f"{PERIODS}, {STATUS}"
    return told.groupBy("key").transformWithState(JobProcessor(plan, planned or {}, quiet_ms), schema, "Append", "None" if quiet_ms is None else "EventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_once(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Read what there is, write the result below `out` and go on from `checkpoint` the next time; what is in `out` so far."""
    spark = stream.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # state of several variables is kept there only
    try:
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(stream.schema).parquet(out)


def replayed(lines: DataFrame) -> DataFrame:
    """Periods (key, what, label, began, ended, start) of a stream of lines, read to its present end."""
    spark: SparkSession = lines.sparkSession
    place = work.folder(spark, "jobs")
    return run_once(periods(lines), f"{place}/out", f"{place}/checkpoint").select("key", "what", "label", "began", "ended", "start")
