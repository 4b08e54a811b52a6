"""Edits of recordings, replayed from their log: moments are split at a word and put together again, with their effects, trims
and every variant's list of kept moments; each edit leaves what undoes it, so that an earlier state can be restored.

All rows of a recording meet in one shuffle and are read in order: segments, documents, variants, then edits. The state is
the recording's own; the undo log holds for each edit only the values that it replaced.

Defined cases. An edit that can't be done (an unknown moment, a single word, a part that isn't one, a number that was never
given, null) changes nothing and is told as refused. Documents that aren't objects count as empty, rows without a key are a
recording of their own. Equal times are decided by the first word. Empty tables give empty results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How part ids are built, and how long before its first word a moment begins.
PART_BASE, PART_STEP, LEAD = 1_000_000, 1000, 0.05
EFFECTS = ("sfx", "vfx")
RANK = {"segment": 0, "document": 1, "variant": 2, "edit": 3}


def number(v: Any) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


def shifted(effects: Any, by: float, wanted: Any) -> list:
    """Effects whose time is wanted, moved; those without a time count as at the start and are not moved."""
    out = []
    for e in effects if isinstance(effects, list) else []:
        if isinstance(e, dict) and "at" in e:
            at = number(e["at"]) if e["at"] else 0.0
            if wanted(at):
                out.append(e | {"at": round(max(0.0, at + by), 3)})
        elif wanted(0.0):
            out.append(e)
    return out


def trim_of(d: dict, side: str) -> float | None:
    trim = d.get("trim")
    return number(trim[side]) if isinstance(trim, dict) and trim.get(side) is not None else None


def trim(first: float | None, last: float | None) -> dict | None:
    if first is None and last is None:
        return None
    return {"in": None if first is None else round(max(0.0, first), 2), "out": None if last is None else round(max(0.0, last), 2)}


def is_id(x: Any, id_: int) -> bool:
    return isinstance(x, bool | int | float) and float(x) == float(id_)


def on_list(keep: list, id_: int) -> bool:
    return any(is_id(x, id_) or (isinstance(x, str) and x.split("/")[0] == str(id_)) for x in keep)


class Recording:
    """Segments with their cuts, documents of moments and lists of variants; what edits do to them."""

    def __init__(self) -> None:
        self.segments: dict[int, dict] = {}  # start, end, words [[begin, end], …]
        self.cuts: dict[int, list[int]] = {}
        self.documents: dict[int, dict] = {}
        self.keep: dict[str, list] = {}
        self.undo: list[list[tuple]] = []  # of each edit: (table, key, value before or None)

    def parts(self, segment: int) -> list[dict]:
        """A segment's parts: id, start, end, first and last word (exclusive)."""
        s = self.segments[segment]
        n = len(s["words"])
        at = [0, *[k for k in self.cuts.get(segment, []) if 0 < k < n], n]
        out = []
        for j, (a, b) in enumerate(zip(at, at[1:])):
            out.append({
                "id": segment if j == 0 else PART_BASE + segment * PART_STEP + a,
                "start": s["start"] if j == 0 else s["words"][a][0],
                "end": s["end"] if b == n else s["words"][b - 1][1],
                "words": (a, b),
            })
        return out

    def find(self, id_: Any) -> tuple[int, list[dict], int] | None:
        """A moment's segment, the segment's parts, and its place among them."""
        if not isinstance(id_, int) or isinstance(id_, bool):
            return None
        segment = id_ if id_ in self.segments else (id_ - PART_BASE) // PART_STEP
        if segment not in self.segments:
            return None
        parts = self.parts(segment)
        return next(((segment, parts, k) for k, p in enumerate(parts) if p["id"] == id_), None)

    def put(self, undo: list[tuple], table: str, key: Any, value: Any) -> None:
        rows = getattr(self, table)
        undo.append((table, key, rows.get(key)))
        if value is None:
            rows.pop(key, None)
        else:
            rows[key] = value

    def split(self, undo: list[tuple], id_: int, t: float) -> bool:
        found = self.find(id_)
        if found is None:
            return False
        segment, parts, place = found
        part, words = parts[place], self.segments[segment]["words"]
        first, last = part["words"]
        if last - first < 2:
            return False
        base = max(0.0, part["start"] - LEAD)
        at = min(range(first + 1, last), key=lambda k: abs(words[k][0] - (base + t)))
        self.put(undo, "cuts", segment, sorted({*self.cuts.get(segment, []), at}))
        second = PART_BASE + segment * PART_STEP + at
        cut = words[at][0] - base
        by = max(0.0, words[at][0] - LEAD) - base
        if d := self.documents.get(id_):
            d = dict(d)
            moved = {k: shifted(d[k], -by, lambda x: x >= cut) for k in EFFECTS if isinstance(d.get(k), list)}
            d |= {k: shifted(d[k], 0.0, lambda x: x < cut) for k in moved}
            t_in, t_out = trim_of(d, "in"), trim_of(d, "out")
            if d.get("trim") is not None:
                d["trim"] = trim(t_in if t_in is not None and t_in < cut else None, None)
            d |= {"text": None, "alts": None}
            self.put(undo, "documents", id_, d)
            rest = t_out - by if t_out is not None and t_out - by > 0 else None
            if moved or d.get("focus") or rest is not None:
                new = {"rush": d.get("rush")} | moved | ({"focus": d["focus"]} if d.get("focus") else {}) | ({"trim": trim(None, rest)} if rest is not None else {})
                self.put(undo, "documents", second, new)
        for variant, keep in list(self.keep.items()):
            if on_list(keep, id_) and not any(is_id(x, second) for x in keep):
                self.put(undo, "keep", variant, [*keep, second])
        return True

    def unsplit(self, undo: list[tuple], id_: int) -> bool:
        found = self.find(id_)
        if found is None or found[2] == 0:
            return False  # the first part keeps the moment's id: nothing before it to be put to
        segment, parts, place = found
        part, before = parts[place], parts[place - 1]
        self.put(undo, "cuts", segment, [k for k in self.cuts[segment] if k != part["words"][0]])
        first, d = dict(self.documents.get(before["id"], {})), self.documents.get(id_, {})
        by = max(0.0, part["start"] - LEAD) - max(0.0, before["start"] - LEAD)
        for k in EFFECTS:
            if isinstance(d.get(k), list):
                first[k] = [*(first[k] if isinstance(first.get(k), list) else []), *shifted(d[k], by, lambda _: True)]
        if first.get("rush") or d.get("rush"):
            t_out = trim_of(d, "out")
            first |= {"rush": first.get("rush") or d.get("rush"), "text": None, "alts": None, "trim": trim(trim_of(first, "in"), None if t_out is None else t_out + by)}
            self.put(undo, "documents", before["id"], first)
        for variant, keep in list(self.keep.items()):
            new = [x for x in keep if not on_list([x], id_)]
            if on_list(keep, id_) and not on_list(keep, before["id"]):
                new.append(before["id"])
            if new != keep:
                self.put(undo, "keep", variant, new)
        return True

    def restore(self, undo: list[tuple], to: int) -> bool:
        """Back to the state after the first `to` edits: later ones are undone, last first. This can be undone like any edit."""
        if not isinstance(to, int) or isinstance(to, bool) or not 0 <= to <= len(self.undo):
            return False
        for changes in reversed(self.undo[to:]):
            for table, key, value in reversed(changes):
                self.put(undo, table, key, value)
        return True

    def edit(self, body: Any) -> bool:
        undo: list[tuple] = []
        op = body.get("op") if isinstance(body, dict) else None
        if op == "split":
            done = self.split(undo, body.get("id"), number(body.get("t")))
        elif op == "unsplit":
            done = self.unsplit(undo, body.get("id"))
        else:
            done = op == "restore" and self.restore(undo, body.get("to"))
        self.undo.append(undo)
        return done

    def rows(self) -> Iterator[tuple[str, str, Any]]:
        for segment in sorted(self.segments):
            for part in self.parts(segment):
                yield "part", str(part["id"]), {"start": part["start"], "end": part["end"], "words": list(part["words"])}
        for id_ in sorted(self.documents):
            yield "document", str(id_), self.documents[id_]
        for variant in sorted(self.keep):
            yield "variant", variant, self.keep[variant]


def parsed(text: str | None) -> Any:
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def read_row(state: Recording, what: str, id_: str, body: Any) -> None:
    if what == "segment" and isinstance(body, dict):
        state.segments[int(id_)] = body
    elif what == "document" and isinstance(body, dict):
        state.documents[int(id_)] = body.get("data") if isinstance(body.get("data"), dict) else {} if "data" in body else body
    elif what == "variant" and isinstance(body, dict):
        body = body["data"] if isinstance(body.get("data"), dict) else body
        if isinstance(body.get("keep"), list):
            state.keep[id_] = body["keep"]


SCHEMA = "key long, what string, id string, body string"


def replay_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: Any = None
    state = Recording()

    def told(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], ["key", "what", "id", "body"])

    def left(key: Any) -> list[tuple]:
        return [(key, what, id_, json.dumps(body, sort_keys=True)) for what, id_, body in state.rows()]

    started = False
    for batch in batches:
        out: list[tuple] = []
        for key, what, id_, body in zip(*(batch.column(c).to_pylist() for c in ("key", "what", "id", "body")), strict=True):
            if not started or key != now:
                out += left(now) if started else []
                now, state, started = key, Recording(), True
            if what == "edit":
                out.append((key, "edit", id_, "done" if state.edit(parsed(body)) else "refused"))
            else:
                read_row(state, what, id_, parsed(body))
        yield told(out)
    if started:
        yield told(left(now))


def replayed(segments: DataFrame, documents: DataFrame, variants: DataFrame, edits: DataFrame) -> DataFrame:
    """(key, what, id, body): the parts, documents and variants' lists that the edits leave, as JSON, and for each edit whether
    it was done or refused. Inputs are (key, id, body) with JSON bodies; an edit's id is its number in the log."""

    def rows(df: DataFrame, what: str, id_: Column) -> DataFrame:
        number = id_.try_cast("long")
        return df.select(F.col("key").cast("long").alias("key"), F.lit(RANK[what]).alias("rank"), number.alias("n"), F.lit(what).alias("what"), id_.cast("string").alias("id"), "body")

    every = rows(segments, "segment", F.col("id"))
    for df, what in ((documents, "document"), (variants, "variant"), (edits, "edit")):
        every = every.unionAll(rows(df, what, F.col("id")))
    dealt = every.repartition("key").sortWithinPartitions("key", "rank", "n", "id")
    return dealt.select("key", "what", "id", "body").mapInArrow(replay_batches, SCHEMA)
